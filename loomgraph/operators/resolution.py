"""Edge resolution: ordered strategies as joins, each by equal keys, ambiguity giving no answer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import COMMON_CALLS, certainty_of, common_call
from loomgraph.operators.relational import unmarked
from loomgraph.operators.traverse import durable
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import tasks_for, written_rows

#: The confidence of each strategy, in the order in which they are asked.
SAME_FILE, SAME_MODULE, GLOBAL_UNIQUE = 0.95, 0.80, 0.62


#: Targets whose calls stay resolved whatever the confidence, by the start of their canonical id.
PROTECTED = ("tauri:command:", "openapi:endpoint:", "route_endpoint:", "payload:collection:")


def stale_cleanup(edges: DataFrame, nodes: DataFrame, floor: float = 0.55) -> DataFrame:
    """Calls lose target, confidence and certainty where their confidence is below ``floor``, protected
    targets apart, or where their target has a common name and they are not certain."""
    shield = reduce(Column.__or__, [F.col("canonical_id").startswith(p) for p in PROTECTED])
    targets = nodes.select(F.col("id").alias("target"), F.coalesce(shield, F.lit(False)).alias("_shield"), F.lower("serialized_name").isin(*COMMON_CALLS).alias("_common"))
    e = edges.join(targets, "target", "left")
    low = F.coalesce(F.col("confidence") < floor, F.lit(False)) & ~F.coalesce("_shield", F.lit(False))
    common = F.coalesce("_common", F.lit(False)) & F.col("resolved_target").isNotNull() & (F.coalesce("certainty", certainty_of(), F.lit("")) != "certain")
    drop = (F.col("kind") == "CALL") & (low | common)
    return e.withColumns({c: F.when(~drop, F.col(c)) for c in ("resolved_target", "confidence", "certainty")}).select(*unmarked(edges))


def cascade(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """(edge_id, node_id, confidence, strategy) for ``requests`` (edge_id, name, file_id, module).

    ``candidates``: (node_id, name, file_id, module). The first candidate of the same file wins, then
    of the same module, then one whose name nobody else has. Candidates are reduced to a row per key
    before each join, so a common name cannot multiply requests.
    """

    def first(*keys: str) -> DataFrame:
        return candidates.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("node_id").alias("node_id"))

    unique = candidates.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("node_id")).where("c = 1").drop("c")
    found = (
        requests.join(first("file_id", "name").withColumnRenamed("node_id", "n1"), ["file_id", "name"], "left")
        .join(first("module", "name").withColumnRenamed("node_id", "n2"), ["module", "name"], "left").join(unique.withColumnRenamed("node_id", "n3"), "name", "left")
    )
    choice = lambda a, b, c: F.when(F.col("n1").isNotNull(), a).when(F.col("n2").isNotNull(), b).when(F.col("n3").isNotNull(), c)
    out = found.select("edge_id", F.coalesce("n1", "n2", "n3").alias("node_id"), choice(SAME_FILE, SAME_MODULE, GLOBAL_UNIQUE).alias("confidence"), choice("same_file", "same_module", "global_unique").alias("strategy"))
    return out.where("node_id is not null")


def unambiguous_best(candidates: DataFrame) -> DataFrame:
    """(edge_id, node_id, confidence): the most confident node, none where different nodes tie."""
    best = candidates.groupBy("edge_id", "node_id").agg(F.max("confidence").alias("confidence"))
    top = best.groupBy("edge_id").agg(F.max("confidence").alias("confidence"))
    tied = best.join(top, ["edge_id", "confidence"]).groupBy("edge_id", "confidence").agg(F.count(F.lit(1)).alias("c"), F.min("node_id").alias("node_id"))
    return tied.where("c = 1").select("edge_id", "node_id", "confidence")


def apply_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """``edges`` with the target and confidence of ``updates`` (edge_id, node_id, confidence), others as they are."""
    u = updates.select(F.col("edge_id").alias("id"), "node_id", F.col("confidence").alias("new_confidence"))
    taken = edges.join(u, "id", "left").withColumns({"resolved_target": F.coalesce("node_id", "resolved_target"), "confidence": F.coalesce("new_confidence", "confidence")})
    return taken.select(*unmarked(edges))


def in_scope(edges: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges whose source is in one of ``files`` (file_id); no file, no edge."""
    callers = nodes.join(files.select("file_id").distinct(), "file_id", "left_semi").select(F.col("id").alias("source"))
    return edges.join(callers, "source", "left_semi")


def ancestors(inheritance: DataFrame) -> DataFrame:
    """(type, ancestor) over ``inheritance`` (child, parent) to the fixpoint; a type is not its own ancestor.

    Each round joins the pairs found last with the steps, and writes only what is new.
    """
    steps = durable(inheritance.select(F.col("child").alias("type"), F.col("parent").alias("ancestor")).where("type <> ancestor").distinct())
    seen = frontier = steps
    fresh = 1
    while fresh:
        further = frontier.alias("f").join(steps.alias("s"), F.col("f.ancestor") == F.col("s.type")).select(F.col("f.type").alias("a"), F.col("s.ancestor").alias("b")).where("a <> b").distinct()
        known = (F.col("a") == F.col("type")) & (F.col("b") == F.col("ancestor"))
        frontier, fresh = written_rows(further.join(seen, known, "left_anti").toDF("type", "ancestor"))
        seen = seen.unionByName(frontier)
    return seen


def overrides(g: Graph) -> DataFrame:
    """(method, overridden): a method to the one of its name in its owner's ancestors; several owners give none."""
    member = g.edge.where("kind = 'MEMBER'").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    own = g.node.where("kind = 'METHOD'").join(member, "id").select("id", "owner", F.element_at(F.split("serialized_name", "::|\\."), -1).alias("short"))
    single = own.groupBy("id", "short").agg(F.count_distinct("owner").alias("c"), F.min("owner").alias("type")).where("c = 1").drop("c")
    above = ancestors(g.edge.where("kind = 'INHERITANCE'").select(F.col("source").alias("child"), F.coalesce("resolved_target", "target").alias("parent")))
    named = own.select(F.col("owner").alias("ancestor"), "short", F.col("id").alias("other"))
    hits = single.join(above, "type").join(named, ["ancestor", "short"])
    return hits.groupBy(F.col("id").alias("method")).agg(F.count_distinct("ancestor").alias("c"), F.min("other").alias("overridden")).where("c = 1").drop("c")


def delete_files(g: Graph, files: DataFrame) -> Graph:
    """The graph without ``files`` (file_id): their nodes, edges at those, and occurrences in or of them."""
    gone = files.select("file_id").distinct()
    dead = g.node.join(gone, "file_id", "left_semi").select("id")
    edge = reduce(lambda e, end: e.join(dead.select(F.col("id").alias(end)), end, "left_anti"), ("source", "target"), g.edge)
    # Edges without a resolution share no key: they are dealt by their ids, else they would be one task's work. How many tasks
    # there are goes by rows, for rows of a few values are small where they are shuffled and large where they are sorted.
    tasks = tasks_for(g.edge.sparkSession, g.edge.count())
    keys = ["resolved_target", "unresolved"]
    lost = dead.select(F.col("id").alias("resolved_target"), F.lit(-1).cast("long").alias("unresolved"), F.lit(True).alias("lost"))
    edge = edge.withColumn("unresolved", F.when(F.col("resolved_target").isNull(), F.pmod("id", F.lit(4093))).otherwise(F.lit(-1).cast("long")))
    edge = edge.repartition(tasks, *keys).join(lost.repartition(tasks, *keys), keys, "left").withColumn("resolved_target", F.when(F.col("lost").isNull(), F.col("resolved_target"))).select(*unmarked(g.edge))
    occurrence = g.occurrence.join(gone, "file_id", "left_anti").join(dead.select(F.col("id").alias("element_id")), "element_id", "left_anti")
    return Graph(g.node.join(gone, "file_id", "left_anti"), edge, occurrence.select(*g.occurrence.columns), g.file.join(gone.select(F.col("file_id").alias("id")), "id", "left_anti"))


def hits_per_file(hits: DataFrame, most: int = 2) -> DataFrame:
    """``hits`` (id, path, score, exact): exact ones all, others at most ``most`` a file, best first."""
    by = Window.partitionBy("path", "exact").orderBy(F.desc("score"), "id")
    return hits.withColumn("place", F.row_number().over(by)).where(F.col("exact") | (F.col("place") <= most)).drop("place")


@dataclass(frozen=True)
class Policy:
    """Confidences and floors of resolution; ``legacy`` trusts no common name at all."""

    min_call: float = 0.55
    same_file: float = SAME_FILE
    same_module: float = SAME_MODULE
    global_unique: float = GLOBAL_UNIQUE
    owner: float = 0.95
    import_relative: float = 0.85
    import_same_file: float = 0.90
    import_same_module: float = 0.75
    import_global: float = 0.55
    import_fuzzy: float = 0.35
    legacy: bool = False


def tail(name: Column) -> Column:
    """The last segment of a qualified name, in lower case."""
    return F.lower(F.element_at(F.split(name, "::|\\."), -1))


def _first(candidates: DataFrame, *keys: str) -> DataFrame:
    """The least node of each key; null keys match nothing."""
    return candidates.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min("node_id").alias("node_id"))


def _only(candidates: DataFrame, *keys: str) -> DataFrame:
    """The node of each key that has exactly one."""
    c = candidates.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys)
    return c.agg(F.count_distinct("node_id").alias("c"), F.min("node_id").alias("node_id")).where("c = 1").drop("c")


def choose(requests: DataFrame, ways: list[tuple[str, float, DataFrame, list[str]]], *keep: str) -> DataFrame:
    """(edge_id, node_id, confidence, strategy): of the ways in order the first that knows the request's keys.

    A way is a name, a confidence, one row a key with ``node_id``, and the keys, which are columns of ``requests``.
    """
    found = requests
    for k, (_, _, matches, keys) in enumerate(ways):
        found = found.join(matches.select(*keys, F.col("node_id").alias(f"_n{k}")), keys, "left")
    pick = lambda values: reduce(lambda w, k: w.when(F.col(f"_n{k}").isNotNull(), values[k]), range(len(ways)), F)
    out = found.select("edge_id", F.coalesce(*[F.col(f"_n{k}") for k in range(len(ways))]).alias("node_id"), pick([w[1] for w in ways]).alias("confidence"), pick([w[0] for w in ways]).alias("strategy"), *keep)
    return out.where("node_id is not null")


def call_cascade(requests: DataFrame, candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Calls (edge_id, name, file_id, module, owner; owner null where the receiver is not known) against
    callables (node_id, name, file_id, module, owner).

    Same file, then same module, each by exact name before the lower-case last segment; then the owner's
    only member of that name; and only where no receiver is known, the one node of that name anywhere.
    A common name without certainty resolves nowhere but in its own file.
    """
    q = requests.withColumn("tail", tail(F.col("name"))).withColumn("free", F.when(F.col("owner").isNull(), F.col("name")))
    c = candidates.withColumn("tail", tail(F.col("name")))
    ways = [
        ("same_file", policy.same_file, _first(c, "file_id", "name"), ["file_id", "name"]), ("same_file", policy.same_file, _first(c, "file_id", "tail"), ["file_id", "tail"]),
        ("same_module", policy.same_module, _first(c, "module", "name"), ["module", "name"]), ("same_module", policy.same_module, _first(c, "module", "tail"), ["module", "tail"]),
        ("owner_member", policy.owner, _only(c, "owner", "tail"), ["owner", "tail"]), ("global_unique", policy.global_unique, _only(c, "name").withColumnRenamed("name", "free"), ["free"]),
    ]
    return gate_common(choose(q, ways, "name")).drop("name")


def gate_common(found: DataFrame, certain: float = 0.85) -> DataFrame:
    """``found`` without the unsure targets of calls whose name (name) is a common one."""
    return found.where(~common_call(F.col("name")) | (F.col("confidence") >= certain))


def candidate_paths(name: Column, folder: Column, language: Column) -> Column:
    """The files that an import may mean, the likeliest first."""
    bare = F.regexp_replace(name, r"^\./", "")
    near = F.when(folder == "", bare).otherwise(F.concat_ws("/", folder, bare))
    dotted, scoped = F.regexp_replace(name, r"\.", "/"), F.regexp_replace(F.regexp_replace(name, "^crate::", "src/"), "::", "/")
    ends = lambda stem, *endings: F.array(*[F.concat(stem, F.lit(e)) for e in endings])
    return F.when(language == "python", ends(dotted, ".py", "/__init__.py")).when(language == "rust", ends(scoped, ".rs", "/mod.rs")).otherwise(ends(near, ".ts", ".tsx", ".js", "/index.ts", "/index.js"))


def import_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(edge_id, file_id, path) for imports (edge_id, name, folder, language): the first candidate that is a file."""
    c = imports.select("edge_id", F.posexplode(candidate_paths(F.col("name"), F.col("folder"), F.col("language"))).alias("ord", "path"))
    hits = c.join(files.select("path", F.col("id").alias("file_id")), "path")
    return hits.groupBy("edge_id").agg(F.min(F.struct("ord", "file_id", "path")).alias("h")).select("edge_id", "h.file_id", "h.path")


def import_cascade(requests: DataFrame, candidates: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Imports (edge_id, name, file_id, module, relative) against symbols (node_id, name, file_id, module).

    ``relative`` is the file that a relative import names; such an import is looked for there and in
    its own file only. Others go on to the module, the one symbol of the name, and one by last segment.
    """
    q = requests.withColumn("tail", tail(F.col("name")))
    far = F.col("relative").isNull()
    q = q.withColumns({"far_module": F.when(far, F.col("module")), "far_name": F.when(far, F.col("name")), "far_tail": F.when(far, F.col("tail"))})
    c = candidates.withColumn("tail", tail(F.col("name")))
    ways = [
        ("relative", policy.import_relative, _first(c, "file_id", "tail").withColumnRenamed("file_id", "relative"), ["relative", "tail"]), ("same_file", policy.import_same_file, _first(c, "file_id", "name"), ["file_id", "name"]),
        ("same_module", policy.import_same_module, _first(c, "module", "name").withColumnRenamed("module", "far_module"), ["far_module", "name"]), ("global", policy.import_global, _only(c, "name").withColumnRenamed("name", "far_name"), ["far_name"]),
        ("fuzzy", policy.import_fuzzy, _first(c, "tail").withColumnRenamed("tail", "far_tail"), ["far_tail"]),
    ]
    return choose(q, ways)


def semantic_fallback(requests: DataFrame, candidates: DataFrame, policy: Policy = Policy(), most: int = 3) -> DataFrame:
    """(edge_id, node_id, confidence) of at most ``most`` candidates (node_id, tail, family, file_id) for requests (edge_id, tail,
    family, file_id): those in the same file, and only where there is none those elsewhere.

    Candidates are first reduced to the least few of each key, so a name that half of all symbols have joins few rows.
    """
    few = lambda keys: candidates.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("node_id"))).where(F.col("_n") <= most).select("node_id", *keys)
    near = requests.join(few(["tail", "family", "file_id"]), ["tail", "family", "file_id"]).select("edge_id", "node_id", F.lit(policy.same_file).alias("confidence"))
    rest = requests.join(near.select("edge_id").distinct(), "edge_id", "left_anti")
    return near.unionByName(rest.join(few(["tail", "family"]), ["tail", "family"]).select("edge_id", "node_id", F.lit(policy.global_unique).alias("confidence")))


def owner_members(g: Graph) -> DataFrame:
    """(node_id, name, file_id, module, owner): callables with the name of the type they are members of, if only one."""
    member = g.edge.where("kind = 'MEMBER'").select(F.col("source").alias("owner_id"), F.col("target").alias("node_id"))
    single = member.groupBy("node_id").agg(F.count_distinct("owner_id").alias("c"), F.min("owner_id").alias("owner_id")).where("c = 1").drop("c")
    owner = g.node.select(F.col("id").alias("owner_id"), F.col("serialized_name").alias("owner"))
    n = g.node.where(F.col("kind").isin("FUNCTION", "METHOD", "MACRO")).select(F.col("id").alias("node_id"), F.col("serialized_name").alias("name"), "file_id")
    return n.join(single, "node_id", "left").join(owner, "owner_id", "left").select("node_id", "name", "file_id", "owner")


def component_references(placeholders: DataFrame, declarations: DataFrame, component: DataFrame) -> DataFrame:
    """(edge_id, node_id): a reference (edge_id, name, part) to the only declaration (node_id, name, part) of its name in its
    component; ``component`` (id, root) gives that of each part."""
    root = lambda df: df.join(component.select(F.col("id").alias("part"), "root"), "part")
    return root(placeholders).join(_only(root(declarations), "root", "name"), ["root", "name"]).select("edge_id", "node_id")


def changed_files(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(path, file_id) for changed paths (path), however their case and separators are written."""
    same = lambda c: F.lower(F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", ""))
    known = files.select(F.col("id").alias("file_id"), same(F.col("path")).alias("_same"))
    return changes.join(known, same(F.col("path")) == F.col("_same")).select("path", "file_id")


def resolve_calls(g: Graph, policy: Policy = Policy()) -> Graph:
    """One pass: unsure calls are reset, what is open is resolved by the cascade, and the edges are rewritten."""
    cleaned = stale_cleanup(g.edge, g.node, policy.min_call)
    open_ = cleaned.where("kind = 'CALL' and resolved_target is null and confidence is null and certainty is null")
    module = g.file.select(F.col("id").alias("file_id"), F.regexp_extract("path", "^(.*)/", 1).alias("module"))
    requests = open_.select(F.col("id").alias("edge_id"), F.col("target_name").alias("name"), "file_id", F.lit(None).cast("string").alias("owner")).join(module, "file_id", "left")
    found = call_cascade(requests, owner_members(g).join(module, "file_id", "left"), policy)
    return Graph(g.node, apply_updates(cleaned, found.select("edge_id", "node_id", "confidence")), g.occurrence, g.file, g.error)
