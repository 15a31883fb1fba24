"""One pass of resolution over a graph: calls, imports, overrides and components, as staged updates with their candidates.

Each kind of edge is resolved against frames reduced to a row a key before they are joined, so a common name
multiplies nothing. What a step found is kept as a candidate even where it is not taken. Updates are written first and then applied at
once, so a pass that is cut leaves the edges as they were.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import certainty_of, common_call
from loomgraph.operators import resolution as r
from loomgraph.operators.relational import unmarked
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import written

UPDATE = ("edge_id", "kind", "node_id", "confidence", "certainty", "strategy", "candidates")


def resolved_calls(requests: DataFrame, candidates: DataFrame, bindings: DataFrame, semantic: DataFrame, policy: r.Policy = r.Policy()) -> DataFrame:
    """(edge_id, node_id, confidence, strategy, candidates) for calls, a row each; null where none is taken.

    ``requests``: (edge_id, name, target, file_id, module, folder, root, owner, member_call); ``candidates``: callables
    (node_id, name, file_id, module, folder, root, owner); ``bindings``: (node_id) of names that imports bind; ``semantic``: (edge_id, node_id, confidence).

    In order: the imported name itself; the same file, by name and then by last segment; the same module, unless the name is a common one; the only
    member of the known owner in the folder, then below the root; and where no owner is known the one node of the name anywhere, or of its
    qualified owner's members. Last what is semantically likeliest, if one is. A call on a receiver of which nothing is
    known stays open. A common name is taken only where it is certain, under the legacy policy never.
    """
    q = requests.withColumn("tail", r.tail(F.col("name"))).withColumns({
        "free": F.when(F.col("owner").isNull(), F.col("name")), "blocked": F.col("member_call") & F.col("owner").isNull(),
        "alias_owner": F.when(F.col("owner").isNull(), F.regexp_extract("name", r"(\w+)(?:::|\.)\w+$", 1)),
    })
    c = candidates.withColumn("tail", r.tail(F.col("name")))
    ways = {
        "binding": (bindings.select(F.col("node_id").alias("target"), "node_id").distinct(), ["target"]),
        "same_file": (r._first(c, "file_id", "name"), ["file_id", "name"]), "same_file_tail": (r._first(c, "file_id", "tail"), ["file_id", "tail"]),
        "same_module": (r._first(c, "module", "name"), ["module", "name"]), "same_module_tail": (r._first(c, "module", "tail"), ["module", "tail"]),
        "folder_owner": (r._only(c, "folder", "owner", "tail"), ["folder", "owner", "tail"]), "root_owner": (r._only(c, "root", "owner", "tail"), ["root", "owner", "tail"]),
        "global_unique": (r._only(c, "name").withColumnRenamed("name", "free"), ["free"]), "owner_alias": (r._only(c, "owner", "tail").withColumnRenamed("owner", "alias_owner"), ["alias_owner", "tail"]),
    }
    for name, (rows, keys) in ways.items():
        q = q.join(rows.select(*keys, F.col("node_id").alias(f"n_{name}")), keys, "left")
    by_edge = semantic.groupBy("edge_id").agg(F.array_sort(F.collect_set(F.struct((-F.col("confidence")).alias("c"), "node_id"))).alias("likely"))
    best = r.unambiguous_best(semantic).select("edge_id", F.col("node_id").alias("n_semantic"), F.col("confidence").alias("semantic_confidence"))
    q = q.join(by_edge, "edge_id", "left").join(best, "edge_id", "left")
    common = common_call(F.col("name"))
    qualified = F.col("name").contains("::") | F.col("name").contains(".")
    have = lambda name: F.col(f"n_{name}").isNotNull()
    no_owner = F.col("owner").isNull()
    steps: list[tuple[Column, str, Column, str]] = [
        (have("binding"), "binding", F.lit(policy.same_file), "import_binding"), (have("same_file"), "same_file", F.lit(policy.same_file), "same_file"), (have("same_file_tail"), "same_file_tail", F.lit(policy.same_file), "same_file"),
        (have("same_module") & ~common, "same_module", F.lit(policy.same_module), "same_module"), (have("same_module_tail") & ~common, "same_module_tail", F.lit(policy.same_module), "same_module"),
        (have("folder_owner"), "folder_owner", F.lit(policy.same_module), "folder_owner"), (have("root_owner"), "root_owner", F.lit(policy.same_file), "root_owner"),
        (have("global_unique") & no_owner, "global_unique", F.when(qualified, policy.same_file).otherwise(policy.global_unique), "global_unique"), (have("owner_alias") & no_owner, "owner_alias", F.lit(policy.same_file), "owner_alias"),
        (have("semantic") & no_owner & (~common | (F.col("semantic_confidence") >= 0.85)), "semantic", F.col("semantic_confidence"), "semantic"),
    ]
    pick = lambda value: reduce(lambda w, s: w.when(s[0], value(s)), steps, F)  # type: ignore[arg-type]
    q = q.withColumns({"node_id": pick(lambda s: F.col(f"n_{s[1]}")), "confidence": pick(lambda s: s[2]), "strategy": pick(lambda s: F.lit(s[3]))})
    taken = ~F.col("blocked") & (~common | ((F.col("confidence") >= 0.85) & F.lit(not policy.legacy)))
    listed = F.concat(F.transform(F.coalesce("likely", F.array().cast("array<struct<c:double,node_id:bigint>>")), lambda x: x["node_id"]), F.array(*[F.col(f"n_{name}") for name in ways]))
    kept = F.when(F.col("blocked"), F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())))
    return q.select("edge_id", *[F.when(taken, F.col(x)).alias(x) for x in ("node_id", "confidence", "strategy")], kept.alias("candidates"))


@dataclass
class Passed:
    """The graph after a pass, its updates (edge_id, kind, node_id, confidence, certainty, strategy, candidates), and (kind, open, resolved)."""

    graph: Graph
    updates: DataFrame
    totals: DataFrame


@dataclass
class Known:
    """What a pass is told besides the graph: receivers of calls (edge_id, owner, member_call), import bindings (node_id), likely targets
    (edge_id, node_id, confidence), and component references: (edge_id, name, part), declarations (node_id, name, part), components (id, root)."""

    receivers: DataFrame | None = None
    bindings: DataFrame | None = None
    semantic: DataFrame | None = None
    references: tuple[DataFrame, DataFrame, DataFrame] | None = None


def resolve(g: Graph, known: Known = Known(), policy: r.Policy = r.Policy(), files: DataFrame | None = None) -> Passed:
    """Reset unsure calls, resolve what is open of each kind, of callers in ``files`` (file_id) if given, and apply all updates at once."""
    spark = g.node.sparkSession
    empty = lambda shape: spark.createDataFrame([], shape)
    cleaned = written(r.stale_cleanup(g.edge, g.node, policy.min_call))
    open_ = cleaned.where("resolved_target is null and confidence is null and certainty is null")
    open_ = open_ if files is None else r.in_scope(open_, g.node, files)
    place = g.file.select(F.col("id").alias("file_id"), F.regexp_extract("path", "^(.*)/", 1).alias("folder"), F.regexp_extract("path", "^([^/]*)/", 1).alias("root"), "path").withColumn("module", F.col("folder"))
    receivers = known.receivers if known.receivers is not None else empty("edge_id long, owner string, member_call boolean")
    calls = open_.where("kind = 'CALL'").select(F.col("id").alias("edge_id"), F.col("target_name").alias("name"), "target", "file_id").join(receivers, "edge_id", "left").join(place, "file_id", "left").withColumn("member_call", F.coalesce("member_call", F.lit(False)))
    found = [resolved_calls(calls, r.owner_members(g).join(place, "file_id", "left"), known.bindings if known.bindings is not None else empty("node_id long"), known.semantic if known.semantic is not None else empty("edge_id long, node_id long, confidence double"), policy).withColumn("kind", F.lit("CALL"))]
    one = lambda df, kind: df.withColumns({"kind": F.lit(kind), "candidates": F.array("node_id")})
    imports = open_.where("kind = 'IMPORT'").select(F.col("id").alias("edge_id"), F.col("target_name").alias("name"), "target", "file_id").join(place, "file_id", "left").join(g.file.select(F.col("id").alias("file_id"), "language"), "file_id", "left")
    near = r.import_files(imports.where("startswith(name, '.')"), g.file).select("edge_id", F.col("file_id").alias("relative"))
    # What an import names stands in its own file until it is resolved, and is no answer to it.
    asked = imports.select(F.col("target").alias("id")).distinct()
    named = g.node.where("kind <> 'FILE'").join(asked, "id", "left_anti").select(F.col("id").alias("node_id"), F.col("serialized_name").alias("name"), "file_id").join(place, "file_id", "left")
    found.append(one(r.import_cascade(imports.withColumn("name", F.regexp_replace("name", r"^(\.\.?/)+", "")).join(near, "edge_id", "left"), named, policy), "IMPORT"))
    above = r.overrides(g).select(F.col("method").alias("source"), F.col("overridden").alias("node_id"))
    overriding = open_.where("kind = 'OVERRIDE'").select(F.col("id").alias("edge_id"), "source").join(above, "source")
    found.append(one(overriding.select("edge_id", "node_id", F.lit(policy.same_file).alias("confidence"), F.lit("ancestor").alias("strategy")), "OVERRIDE"))
    if known.references:
        found.append(one(r.component_references(*known.references).select("edge_id", "node_id", F.lit(policy.same_file).alias("confidence"), F.lit("component").alias("strategy")), "USAGE"))
    updates = written(reduce(DataFrame.unionByName, found).withColumn("certainty", certainty_of()).select(*UPDATE))
    u = updates.where("node_id is not null").select(F.col("edge_id").alias("id"), F.col("node_id").alias("_node"), F.col("confidence").alias("_confidence"), F.col("certainty").alias("_certainty"))
    edge = cleaned.join(u, "id", "left").withColumns({"resolved_target": F.coalesce("_node", "resolved_target"), "confidence": F.coalesce("_confidence", "confidence"), "certainty": F.coalesce("_certainty", "certainty")}).select(*unmarked(g.edge))
    left = open_.groupBy("kind").agg(F.count(F.lit(1)).alias("open")).join(updates.where("node_id is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("resolved")), "kind", "left")
    return Passed(Graph(g.node, edge, g.occurrence, g.file, g.error), updates, left.select("kind", "open", F.coalesce("resolved", F.lit(0)).alias("resolved")))
