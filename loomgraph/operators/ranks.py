"""Orders and scores of hits beyond the lanes: name matches, targets, repository texts, citations, budgets, joins of evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, MODULES, TYPES, certainty_of
from loomgraph.functions.paths import file_role, helper_like, test_or_bench
from loomgraph.operators.grounding import degree_tier
from loomgraph.sources.store import tasks_for

_SPLIT = r"::|\.|#|/"


def squeezed(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_\-]+", ""))


def terminal(name: Column) -> Column:
    return F.element_at(F.split(name, _SPLIT), -1)


def leading(name: Column) -> Column:
    return F.element_at(F.split(name, _SPLIT), 1)


def initials(name: Column) -> Column:
    """First letters of a name's words, at camel humps and marks: ``LoadGraphFile`` gives ``lgf``."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " ")
    return F.lower(F.array_join(F.transform(F.split(F.trim(spaced), " +"), lambda w: F.substring(w, 1, 1)), ""))


def _bit(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("int")


def name_match(query: str, name: Column) -> dict[str, Column]:
    """Exact matches of the whole name, its last and its first segment."""
    q = "".join(c for c in query.strip().lower() if not c.isspace() and c not in "_-")
    return {"exact_display": _bit(squeezed(name) == q), "exact_terminal": _bit(squeezed(terminal(name)) == q), "exact_leading": _bit(squeezed(leading(name)) == q)}


def kind_bucket(kind: Column) -> Column:
    return F.when(kind.isin(*TYPES), 4).when(kind.isin(*CALLABLES), 3).when(kind.isin(*MODULES), 2).when(kind == "FILE", 0).otherwise(1)


#: Words of a query that ask for tests, docs and the like, and for a kind.
OTHER_SOURCES = ("test", "tests", "spec", "fixture", "bench", "benchmark", "docs", "readme", "vendor", "generated")
KIND_WORDS = {"class": TYPES, "struct": TYPES, "type": TYPES, "enum": TYPES, "function": CALLABLES, "method": CALLABLES, "module": MODULES, "namespace": MODULES, "package": MODULES}


def search_rank(query: str, hits: DataFrame) -> DataFrame:
    """Hits (id, name, path, kind, line, entry, callers, callees, place) with their rank's buckets, each better when higher, in order."""
    words = query.lower().split()
    asks_other = any(w in OTHER_SOURCES for w in words)
    m = name_match(query, F.col("name"))
    exact = (m["exact_display"] + m["exact_terminal"] + m["exact_leading"]) > 0
    role = file_role(F.col("path"))
    other = F.coalesce(role.isin("test", "benchmark", "generated", "vendor", "docs"), F.lit(False))
    asked = sorted({k for w in words if w in KIND_WORDS for k in KIND_WORDS[w]})
    terms = [w for w in words if len(w) >= 3]
    low_path, low_name = F.lower(F.coalesce("path", F.lit(""))), F.lower("name")
    count = lambda text: reduce(Column.__add__, [text.contains(t).cast("int") for t in terms], F.lit(0))
    inexact = lambda c: F.when(exact, 0).otherwise(c)
    quality = F.when(exact & F.col("line").isNotNull(), F.when(F.col("kind").isin(*TYPES, *CALLABLES), 2).otherwise(1)).otherwise(0)
    rank = {
        "full_definition": _bit((F.lower("name") == query.strip().lower()) & F.col("line").isNotNull()), "quality": quality, "prefix_path": _bit(low_path.contains(squeezed(leading(F.lit(query)))) & F.lit("::" in query)), **m,
        "source": _bit(exact | F.lit(asks_other) | ~other), "entry": F.coalesce("entry", F.lit(0)), "not_helper": _bit(~helper_like(F.col("name"), F.col("path"))), "in_tier": F.when(other, 0).otherwise(degree_tier(F.col("callers"))), "out_tier": degree_tier(F.col("callees")),
        "shallow": F.greatest(F.lit(3) - F.col("place"), F.lit(0)), "camel": inexact(_bit(initials(terminal(F.col("name"))) == query.strip().lower())), "compound": inexact(count(low_name)), "path_terms": inexact(count(low_path)),
        "kind_asked": _bit(F.col("kind").isin(*asked)) if asked else F.lit(0), "kind": kind_bucket(F.col("kind")),
    }
    return hits.select("*", F.struct(*[c.cast("int").alias(k) for k, c in rank.items()]).alias("rank"))


def by_rank(hits: DataFrame, limit: int) -> DataFrame:
    """The best hits by the rank's buckets, each in turn, then by id; ``position`` from 1."""
    order = [F.desc("rank"), F.col("id")]
    return hits.orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)))


def resolution_rank(query: str, hits: DataFrame) -> DataFrame:
    """Hits (id, name, path, kind, line) with the buckets by which one of them is taken as the query's target."""
    q = query.strip()
    m = name_match(q, F.col("name"))
    exact = (m["exact_display"] + m["exact_terminal"] + m["exact_leading"]) > 0
    role = file_role(F.col("path"))
    rank = {
        "anchor": _bit(exact & F.col("line").isNotNull()), **m, "same_case": _bit((F.col("name") == q) | (terminal(F.col("name")) == q)), "truth": _bit(role.isin("source", "entrypoint")),
        "prefix": _bit(~exact & F.startswith(squeezed(F.col("name")), squeezed(F.lit(q)))), "implementation": _bit(~F.coalesce(F.col("path").rlike(r"\.(d\.ts|h|hpp|pyi)$"), F.lit(False))), "kind": kind_bucket(F.col("kind")),
    }
    return hits.select("*", F.struct(*[c.cast("int").alias(k) for k, c in rank.items()]).alias("rank"))


def resolve_target(query: str, hits: DataFrame, path_has: str | None = None, most: int = 50, shown: int = 10) -> DataFrame:
    """(status, id, name, path, position): the one best hit as ``resolved``, or the tied best ones as ``ambiguous``; no row where nothing matches.

    A query without a hit is asked again by its last segment.
    """

    def candidates(text: str) -> DataFrame:
        q = squeezed(F.lit(text))
        found = hits.where(squeezed(F.col("name")).contains(q))
        return (found.where(F.col("path").contains(path_has)) if path_has else found).orderBy(F.length("name"), "name", "id").limit(most)

    found = candidates(query)
    stem = query.replace("::", ".").rsplit(".", 1)[-1]
    if stem != query and found.isEmpty():
        found = candidates(stem)
    ranked = resolution_rank(query, found)
    best = ranked.withColumn("top", F.max("rank").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("rank = top")
    tied = F.count(F.lit(1)).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = best.withColumns({"tied": tied, "position": F.row_number().over(Window.orderBy("path", "name", "id"))}).where(F.col("position") <= shown)
    return out.select(F.when(F.col("tied") > 1, "ambiguous").otherwise("resolved").alias("status"), "id", "name", "path", "position")


def browse_rank(query: str, hits: DataFrame, limit: int = 50) -> DataFrame:
    """(id, name, position) by exact name, last segment, kind, first segment, then id."""
    m = name_match(query, F.col("name"))
    order = [F.desc(m["exact_display"]), F.desc(m["exact_terminal"]), F.desc(kind_bucket(F.col("kind"))), F.desc(m["exact_leading"]), F.col("id")]
    return hits.orderBy(*order).limit(limit).select("id", "name", F.row_number().over(Window.orderBy(*order)).alias("position"))


def merged_by_node(hits: DataFrame, more: DataFrame) -> DataFrame:
    """Hits (id, score, position) with ``more`` after them; a strictly better score takes a node's place, its position stays."""
    both = hits.select("id", "score", "position", F.lit(0).alias("late")).unionByName(more.select("id", "score", "position", F.lit(1).alias("late")))
    first = F.min(F.struct("late", "position"))
    best = F.max(F.struct("score", (-F.col("late")).alias("early"))).alias("b")
    merged = both.groupBy("id").agg(first.alias("f"), best)
    return merged.select("id", "b.score", (F.col("b.early") == -1).alias("replaced"), F.row_number().over(Window.orderBy("f.late", "f.position", "id")).alias("position"))


def unique_inexact(query: str, hits: DataFrame, rows: int | None = None) -> DataFrame:
    """Hits (id, name, kind, path, position): exact ones all, of others the first of each (name, kind, path).

    Positions need only rise. About so many ``rows``, where told, are dealt over tasks by what makes them equal; exact ones, of which all stay, by position too.
    """
    m = name_match(query, F.col("name"))
    exact = (m["exact_display"] + m["exact_terminal"] + m["exact_leading"]) > 0
    same = ("name", "kind", "path", "_apart")
    own = hits.withColumn("_e", exact).withColumn("_apart", F.when(F.col("_e"), F.col("position")))
    if rows is not None:
        own = own.repartition(tasks_for(hits.sparkSession, rows), *same)
    n = F.row_number().over(Window.partitionBy(*same).orderBy("position"))
    return own.withColumn("_n", n).where(F.col("_e") | (F.col("_n") == 1)).drop("_e", "_n", "_apart")


def did_you_mean(hits: DataFrame, most: int = 5) -> DataFrame:
    """The nearest hits (id, lexical, graph, semantic) by meaning, only where no hit matches by words or in the graph."""
    found = F.max(((F.col("lexical") > 0.01) | (F.col("graph") > 0.25)).cast("int")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumn("_found", found).where((F.col("_found") == 0) & (F.col("semantic") >= 0.18)).orderBy(F.desc("semantic"), "id").limit(most).drop("_found")


def text_hits(texts: DataFrame, query: str, terms: list[str], limit: int) -> DataFrame:
    """(path, line, score, position) of texts (path, text, seq) that hold the query or enough of its terms, at their best line.

    Two terms are enough where the path has one, else three, or all of fewer. Texts are split in
    lines where they are; one row a text leaves the scan.
    """
    q = query.strip().lower()
    has = lambda text: [text.contains(t) for t in terms]
    total = lambda text: reduce(Column.__add__, [c.cast("int") for c in has(text)], F.lit(0))
    low, path = F.lower("text"), F.lower(F.translate("path", "\\", "/"))
    either = reduce(Column.__add__, [(a | b).cast("int") for a, b in zip(has(low), has(path))], F.lit(0))
    enough = either >= F.when(total(path) > 0, 2).otherwise(min(3, len(terms)))
    lines = F.split(low, "\n")
    score = F.transform(lines, lambda x, i: F.struct(x.contains(q).cast("int").alias("whole"), total(x).alias("n"), (-i).alias("i")))
    t = texts.where(low.contains(q) | enough).select("path", "seq", path.alias("p"), low.alias("low"), lines.alias("lines"), F.array_max(score).alias("b"))
    line = (-F.col("b.i")).cast("int")
    own = F.get("lines", line)
    points = F.lit(100.0) + F.when(own.contains(q), 220.0).when(F.col("low").contains(q), 140.0).otherwise(0.0) + total(F.col("p")) * 35.0 + total(own) * 28.0 + total(F.col("low")) * 6.0
    top = t.select("path", "seq", (line + 1).alias("line"), points.alias("score")).orderBy("seq").limit(limit)
    return top.withColumn("position", F.row_number().over(Window.orderBy("seq"))).select("path", "line", F.round(F.col("score") - (F.col("position") - 1) * 0.01, 6).alias("score"), "position")


#: The first class whose words a question has.
TASKS = (
    ("bug_localization", ("bug", "error", "failing", "failed", "broken", "crash")), ("change_impact", ("impact", "affected", "regression", "blast radius")), ("route_tracing", ("route", "endpoint", "handler", "api path")),
    ("symbol_ownership", ("owner", "owns", "who calls", "references")), ("data_flow", ("data flow", "flow from", "flow into", "flows from", "flows into", "pipeline", "through")), ("edit_planning", ("where to edit", "edit", "change", "modify", "implement", "add ")),
)


def task_class(question: Column) -> Column:
    low = F.lower(question)
    out = F.lit("architecture_explanation")
    for name, words in reversed(TASKS):
        out = F.when(reduce(Column.__or__, [low.contains(w) for w in words]), name).otherwise(out)
    return out


def citation_score() -> Column:
    """A citation's score (score, indexed, resolvable, name, path, kind): what names a symbol of the sources counts, what is declared elsewhere costs."""
    path, name = F.lower(F.coalesce("path", F.lit(""))), F.lower("name")
    test = test_or_bench(F.col("path"))
    parts = [
        F.when(F.col("indexed"), 1.0), F.when(F.col("resolvable"), 0.5), F.when(name.contains("::"), 0.25), F.when(file_role(F.col("path")).isin("test", "benchmark", "generated", "vendor"), -100.0), F.when(path.rlike(r"\.d\.(ts|cts|mts|tsx)$"), -3.0),
        F.when(path.rlike("^(extensions|vendor|deps)/|/deps/"), -20.0), F.when(test, -18.0), F.when(test & (F.col("kind") == "MODULE"), -20.0), F.when(name.rlike("^[\"'<]|^\\.\\.?/"), -30.0),
    ]
    return F.round(reduce(Column.__add__, [F.coalesce(x, F.lit(0.0)) for x in parts], F.col("score").cast("double")), 6)


def capped(citations: DataFrame, most: int, files: int) -> DataFrame:
    """Citations (id, path, score, protected): protected ones all, others by score, at most ``most`` of them from at most ``files`` files."""
    order = [F.desc("score"), F.col("id")]
    file_best = citations.where(~F.col("protected")).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "id")).alias("b"))
    kept = file_best.orderBy("b", "path").limit(files).select("path")
    rest = citations.where(~F.col("protected")).join(kept, "path", "left_semi").orderBy(*order).limit(most)
    return citations.where("protected").unionByName(rest.select(*citations.columns))


def within_bytes(sections: DataFrame, most: int) -> DataFrame:
    """Sections (ord, text; one an ord) as long as all up to them fit in ``most`` bytes, with the ``bytes`` so far; empty ones are left out.

    No more than ``most`` sections can fit, so the running sum is over that many lengths.
    """
    sizes = sections.select("ord", F.octet_length("text").alias("size")).where("size > 0").orderBy("ord").limit(most + 1)
    upto = F.sum("size").over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fit = sizes.select("ord", upto.alias("bytes")).where(F.col("bytes") <= most)
    return sections.join(F.broadcast(fit), "ord")


def with_roles(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates (path, role) with the role of the stored file at the same path, else the one that the path tells, where they have none."""
    known = files.select(F.lower(F.translate("path", "\\", "/")).alias("_p"), F.col("role").alias("_stored")).dropDuplicates(["_p"])
    joined = candidates.join(known, F.lower(F.translate(F.col("path"), "\\", "/")) == F.col("_p"), "left")
    return joined.select(*[F.coalesce("role", "_stored", file_role(F.col("path"))).alias("role") if c == "role" else F.col(c) for c in candidates.columns])


def with_core(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates (node_id, kind, name, line, role) with what their node tells where they lack it; a name in a test scope makes the role test."""
    n = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("_kind"), F.col("qualified_name").alias("_name"), F.col("start_line").alias("_line"))
    j = candidates.join(n, "node_id", "left")
    name = F.coalesce("name", "_name")
    return j.select("node_id", F.coalesce("kind", "_kind").alias("kind"), name.alias("name"), F.coalesce("line", "_line").alias("line"), F.when(name.rlike("(^|::)tests?::"), "test").otherwise(F.col("role")).alias("role"))


def route_handlers(routes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(route, handler): the best of candidates (route, handler, confidence, certainty, name) by confidence, certainty, name and id."""
    sure = F.coalesce("certainty", certainty_of())
    strength = F.when(sure == "certain", 0).when(sure == "probable", 1).when(sure == "uncertain", 2).otherwise(3)
    order = [F.desc_nulls_last("confidence"), strength, F.col("name"), F.col("handler")]
    best = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("route").orderBy(*order))).where("_n = 1")
    return routes.join(best, "route").select("route", "handler")


def siblings_with_name(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, path) of texts (path, text) beside a hit's header (id, name, path): same folder and stem, another ending, and the whole name in the text."""
    split = lambda df: df.withColumns({"folder": F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "stem": F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1)})
    h = split(hits.where(F.col("path").rlike(r"\.(h|hh|hpp|hxx)$"))).select("id", "name", "folder", "stem", F.col("path").alias("header"))
    t = split(texts.where(F.col("path").rlike(r"\.(c|cc|cpp|cxx)$"))).select("path", "text", "folder", "stem")
    return h.join(t, ["folder", "stem"]).where((F.col("path") != F.col("header")) & F.col("text").contains(F.col("name"))).select("id", "path")


def candidate_mass(candidates: DataFrame) -> DataFrame:
    """(mass): the sum of scores, by which a search sees whether a further stage still adds."""
    return candidates.agg(F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6).alias("mass"))


def nearest_names(names: DataFrame, query: str, limit: int = 20, most: int = 3) -> DataFrame:
    """(id, name, distance) of names within ``most`` edits of the query, exact ones first."""
    q = query.strip().lower()
    distance = F.levenshtein(F.lower(terminal(F.col("name"))), F.lit(q), most)
    near = names.where(F.abs(F.length(terminal(F.col("name"))) - len(q)) <= most).withColumn("distance", distance).where("distance >= 0")
    return near.orderBy("distance", "name", "id").limit(limit).select("id", "name", "distance")


def projected(text: Column, dims: int = 16) -> Column:
    """A vector of length one for a text, by hashed words: each adds one, up or down, at a place that its hash picks."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    # 60 bits of an MD5, so that any engine gives the same vector.
    hashes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 15), 16, 10).cast("long"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(h % dims == d, F.when(F.shiftright(h, 32) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: F.when(norm > 0, F.round(x / norm, 6)).otherwise(F.lit(0.0)))


def prefiltered_top(vectors: DataFrame, query: list[float], k: int, factor: int = 4) -> DataFrame:
    """(id, score): the best by whole products among the ``factor`` * k best by products of bytes; approximate where bytes mislead."""
    peak = max((abs(x) for x in query), default=0.0) or 1.0
    small = F.array(*[F.lit(int(round(127 * x / peak))) for x in query])
    exact = F.array(*[F.lit(float(x)) for x in query])
    rough = F.aggregate(F.zip_with(F.transform("embedding", lambda v: F.round(v.cast("double") * 127).cast("int")), small, lambda a, b: a * b), F.lit(0), lambda s, x: s + x)
    first = vectors.select("id", "embedding", rough.alias("rough")).orderBy(F.desc("rough"), "id").limit(factor * k)
    dot = F.aggregate(F.zip_with("embedding", exact, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    return first.select("id", F.round(dot, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def weighted_hybrid(hits: DataFrame, lexical: float = 0.5, semantic: float = 0.35, graph: float = 0.15, negative: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of hits (id, name, lexical, semantic, near): lexical over its best, and nearness in the graph (0 the centre, 1 a neighbour)."""
    best = F.max("lexical").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    boost = F.when(F.col("near") == 0, 1.0).when(F.col("near") == 1, 0.55).otherwise(0.0)
    score = F.lit(lexical) * F.coalesce(F.try_divide("lexical", best), F.lit(0.0)) + F.lit(semantic) * F.coalesce("semantic", F.lit(0.0)) + F.lit(graph) * boost
    for word in negative:
        score = F.when(F.lower("name").contains(word), score * 0.72).otherwise(score)
    return hits.select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id")
