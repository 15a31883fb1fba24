"""Search over a stored index: lexical lanes on postings, symbol anchors, adjacency, vectors, fusion and final order.

The query is a few tokens on the driver; all that grows with the corpus stays in frames. Each lane ends
in a bounded list (``limit``), so fusion works on at most a few thousand rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import TypeVar

from pyspark import InheritableThread, StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.graph import CALLABLES, DATA, MODULES, TYPES, edge_weight
from loomgraph.functions.paths import extension, file_role, role_rank
from loomgraph.operators.adjacency import adjacency_of
from loomgraph.plans import planner as p
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import written

T = TypeVar("T")
K1, B, RRF_K = 1.2, 0.75, 20
#: Weights of the final score, role priors of a text, and caps of anchors.
FUSED, GRAPH, TEXT, ROLE, OVERLAP = 0.70, 0.15, 0.05, 0.05, 0.05
ANCHOR_WINDOW, ANCHORS, ANCHORS_A_FILE = 24, 8, 2
#: Words by which a query asks for files of a role.
ASKED = {"test": "test tests testing spec specs fixture fixtures", "docs": "doc docs documentation readme", "benchmark": "bench benchmark benchmarks performance", "generated": "generated codegen", "vendor": "vendor dependency dependencies third party"}


def normalised(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(normalised(F.coalesce(text, F.lit(""))), " "), lambda t: t != "")


@dataclass
class Index:
    """docs(key, path, symbol, node_id, kind, line, source, path_len, content_len); postings(term, key, path_tf, content_tf), sorted by term.

    The number of documents and their mean length are counted once, when first asked for.
    """

    docs: DataFrame
    postings: DataFrame
    _size: tuple[int, float] | None = None

    def size(self) -> tuple[int, float]:
        if self._size is None:
            r = self.docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("path_len") + F.col("content_len")).alias("mean")).first()
            self._size = (r.n or 0, r.mean or 1.0)
        return self._size


def build_index(texts: DataFrame, tasks: int | None = None) -> Index:
    """The index of texts (key, path, content, symbol, node_id, kind, line, source).

    Texts are dealt by key once, over ``tasks`` tasks; counting their terms by (key, term) then needs no further shuffle.
    """
    deal = [] if tasks is None else [tasks]
    t = texts.repartition(*deal, "key").withColumns({"path_tokens": tokens_of(F.col("path")), "content_tokens": tokens_of(F.col("content"))})
    docs = t.select("key", "path", "symbol", "node_id", "kind", "line", "source", F.size("path_tokens").alias("path_len"), F.size("content_tokens").alias("content_len"))
    both = t.select("key", F.explode(F.concat(F.transform("path_tokens", lambda x: F.struct(x.alias("term"), F.lit(1).alias("p"), F.lit(0).alias("c"))), F.transform("content_tokens", lambda x: F.struct(x.alias("term"), F.lit(0).alias("p"), F.lit(1).alias("c"))))).alias("t"))
    postings = written(both.groupBy("key", F.col("t.term").alias("term")).agg(F.sum("t.p").alias("path_tf"), F.sum("t.c").alias("content_tf")))
    # Ranges of terms are found by a look at what was written, not by reading the texts twice; a common term is many tasks' work.
    return Index(docs, postings.repartitionByRange(*deal, "term", "key").sortWithinPartitions("term", "key"))


def _any(column: Column, tokens: list[str]) -> Column:
    return reduce(Column.__or__, [column.startswith(t) for t in tokens])


def document_frequencies(index: Index, tokens: list[str]) -> DataFrame:
    """(token, n): documents with a term that starts with the token."""
    wanted = F.array(*[F.struct(F.lit(t).alias("t")) for t in tokens])
    hit = index.postings.where(_any(F.col("term"), tokens)).select("key", F.explode(F.filter(wanted, lambda w: F.startswith(F.col("term"), w["t"]))).alias("w"))
    return hit.select("key", F.col("w.t").alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def matches(index: Index, tokens: list[str]) -> DataFrame:
    """A row for each document that matches a token: its frequencies by token (p0, c0, p1, ...) and its lengths."""
    hit = index.postings.where(_any(F.col("term"), tokens))
    sums = []
    for k, t in enumerate(tokens):
        here = F.col("term").startswith(t)
        sums += [F.sum(F.when(here, F.col("path_tf")).otherwise(0)).alias(f"p{k}"), F.sum(F.when(here, F.col("content_tf")).otherwise(0)).alias(f"c{k}")]
    return hit.groupBy("key").agg(*sums).join(index.docs, "key")


def local(rows: DataFrame) -> DataFrame:
    """A list that a limit bounds, held by the driver, so that what follows does not make it again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


@dataclass
class Totals:
    documents: int
    mean_length: float
    frequency: list[int]


def totals(index: Index, tokens: list[str], found: DataFrame) -> Totals:
    """What a score needs of the corpus; ``found`` are all documents that match a token."""
    counts = found.agg(*[F.sum(((F.col(f"p{k}") + F.col(f"c{k}")) > 0).cast("long")).alias(f"d{k}") for k in range(len(tokens))]).first()
    return Totals(*index.size(), [counts[f"d{k}"] or 0 for k in range(len(tokens))])


def bm25(t: Totals, path_weight: float, content_weight: float) -> Column:
    """BM25 over both columns, weighted; rare tokens weigh by their inverse document frequency."""
    length = F.col("path_len") + F.col("content_len")
    score = F.lit(0.0)
    for k, n in enumerate(t.frequency):
        idf = F.greatest(F.log(F.lit((t.documents - n + 0.5) / (n + 0.5))), F.lit(1e-6))
        tf = F.col(f"p{k}") * F.lit(path_weight) + F.col(f"c{k}") * F.lit(content_weight)
        score = score + idf * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / F.lit(t.mean_length)))
    return F.round(score, 6)


def _weighted(t: Totals, tokens: list[str], quoted: list[str]) -> list[float]:
    return [p.token_weight(n, t.documents) * (2.0 if tok in quoted else 1.0) for tok, n in zip(tokens, t.frequency)]


def _symbol_overlap(tokens: list[str], weights: list[float]) -> Column:
    own = tokens_of(F.col("symbol"))
    return F.round(reduce(Column.__add__, [F.when(F.array_contains(own, t), w).otherwise(0.0) for t, w in zip(tokens, weights)], F.lit(0.0)), 6)


def _found(index: Index, tokens: list[str], keep: bool = False) -> tuple[DataFrame, Totals]:
    """What matches any token, with its BM25 by path and by content; with ``keep`` kept for all lanes to read (a lost part is made again)."""
    rows = matches(index, tokens)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK) if keep else rows
    t = totals(index, tokens, rows)
    scored = rows.withColumns({"by_path": bm25(t, 8.0, 1.0), "by_content": bm25(t, 1.0, 4.0)})
    scored._loomgraph_kept = rows  # type: ignore[attr-defined]
    return scored, t


def lexical_lanes(index: Index, query: str, limit: int, found: tuple[DataFrame, Totals] | None = None) -> DataFrame:
    """(key, lane, rank) of the four lanes: exact names, paths, contents, and symbol documents by their names.

    Each lane is a bounded top list of its own order; ranks count from 1.
    """
    tokens, quoted = p.query_tokens(query), p.quoted_tokens(query)
    most = max(256, min(64 * limit, p.LEXICAL_WINDOW))
    if not tokens:
        return index.docs.sparkSession.createDataFrame([], "key long, lane string, rank int")
    rows, t = found or _found(index, tokens)
    needle = query.strip().lower()
    symbol = F.lower(F.coalesce("symbol", F.lit("")))
    exact = index.docs.where((F.lower("path") == needle) | (symbol == needle) | symbol.endswith("::" + needle) | symbol.endswith("." + needle))
    overlap = _symbol_overlap(tokens, _weighted(t, tokens, quoted))

    def lane(own: DataFrame, name: str, *order: Column) -> DataFrame:
        top = own.orderBy(*order).limit(most)
        return top.select("key", F.lit(name).alias("lane"), F.row_number().over(Window.orderBy(*order)).alias("rank"))

    ends = [F.col("path"), F.col("key")]
    symbols = rows.where("source = 1").orderBy(F.desc("by_content"), *ends).limit(most).withColumn("overlap", overlap)
    return lane(exact, "exact", *ends).unionByName(lane(rows, "path", F.desc("by_path"), *ends)).unionByName(lane(rows, "content", F.desc("by_content"), *ends)).unionByName(lane(symbols, "symbol", F.desc("overlap"), F.desc("by_content"), *ends))


LANES = ("exact", "path", "content", "symbol")


def interleaved(lanes: DataFrame) -> DataFrame:
    """(key, position): exact hits first, then the lanes in turns; each key once, where it comes first."""
    turn = F.when(F.col("lane") == "exact", 0).otherwise(1)
    order = F.struct(turn.alias("t"), "rank", F.array_position(F.array(*[F.lit(x) for x in LANES]), F.col("lane")).alias("l"))
    first = lanes.groupBy("key").agg(F.min(order).alias("o"))
    return first.select("key", F.row_number().over(Window.orderBy("o")).alias("position"))


def sublane_ranks(lanes: DataFrame) -> DataFrame:
    """(key, exact, path, content, symbol): the best rank in each lane, null where it is not."""
    return lanes.groupBy("key").agg(*[F.min(F.when(F.col("lane") == x, F.col("rank"))).alias(f"{x}_rank") for x in LANES])


def reciprocal(ranks: list[Column], weights: tuple[float, ...]) -> Column:
    """Weighted reciprocal ranks over what first places in all lanes would give."""
    total = reduce(Column.__add__, [F.when(r.isNotNull(), F.lit(w) / (RRF_K + F.greatest(r, F.lit(1)))).otherwise(F.lit(0.0)) for r, w in zip(ranks, weights) if w > 0], F.lit(0.0))
    most = sum(weights) / (RRF_K + 1)
    return F.round(total / F.lit(most), 6) if most > 0 else F.lit(0.0)


def lexical_search(index: Index, query: str, limit: int) -> DataFrame:
    """(key, path, symbol, node_id, kind, line, matched, score, place): documents with enough of the query's tokens and all quoted ones, by fused lane ranks."""
    tokens, quoted = p.query_tokens(query), p.quoted_tokens(query)
    if not tokens:
        return index.docs.limit(0).select("key", "path", "symbol", "node_id", "kind", "line", F.lit(0).alias("matched"), F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    found = _found(index, tokens, keep=True)
    lanes = local(lexical_lanes(index, query, limit, found))
    fused = sublane_ranks(lanes).join(interleaved(lanes), "key")
    score = reciprocal([F.col(f"{x}_rank") for x in LANES], p.SUBLANE_WEIGHTS[p.classify(query).shape])
    rows = found[0].join(F.broadcast(fused.select("key", score.alias("score"), "position")), "key")
    has = [(F.col(f"p{k}") + F.col(f"c{k}")) > 0 for k in range(len(tokens))]
    matched = reduce(Column.__add__, [h.cast("int") for h in has])
    must = reduce(Column.__and__, [h for h, t in zip(has, tokens) if t in quoted], F.lit(True))
    rows = rows.withColumn("matched", matched).where((F.col("matched") >= p.required_matches(len(tokens))) & must)
    order = [F.desc("score"), F.col("position")]
    top = local(rows.orderBy(*order).limit(limit).select("key", "path", "symbol", "node_id", "kind", "line", "matched", "score", "position"))
    found[0]._loomgraph_kept.unpersist()  # type: ignore[attr-defined]
    return top.select("key", "path", "symbol", "node_id", "kind", "line", "matched", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


def excerpt(text: Column, tokens: list[str], before: int = 192, most: int = 128, after: int = 192) -> Column:
    """(line, start, excerpt) of the first place in a text where a token stands, ignoring case; null where there is none."""
    low = F.lower(text)
    at = reduce(F.least, [F.when(F.locate(t, low) > 0, F.locate(t, low)) for t in tokens]) if len(tokens) > 1 else F.when(F.locate(tokens[0], low) > 0, F.locate(tokens[0], low))
    left = F.substring(text, F.lit(1), at - 1)
    line = F.size(F.split(left, "\n"))
    here = F.element_at(F.split(left, "\n"), -1)
    head = F.substring(here, F.greatest(F.length(here) - before + 1, F.lit(1)), F.lit(before))
    rest = F.element_at(F.split(F.substring(text, at, F.lit(most + after)), "\n"), 1)
    return F.when(at.isNotNull(), F.struct(line.alias("line"), at.alias("start"), F.concat(head, rest).alias("excerpt")))


def cosine_top(vectors: DataFrame, query: list[float], k: int, floor: float = 0.30, margin: float = 0.10) -> DataFrame:
    """(id, score): vectors (id, embedding) by cosine, exact, those over the floor and near the best.

    Vectors of another length, with a missing or endless component or without a direction take no part;
    a query of that kind is an error.
    """
    norm = sum(x * x for x in query) ** 0.5
    if not query or norm == 0 or norm != norm or norm == float("inf"):
        raise ValueError("the query vector has no direction")
    q = F.array(*[F.lit(float(x) / norm) for x in query])
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.size("embedding") == len(query)) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fold = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    own = vectors.where(fine).select("id", fold(F.zip_with(x, q, lambda a, b: a * b)).alias("dot"), F.sqrt(fold(F.transform(x, lambda v: v * v))).alias("norm")).where("norm > 0")
    top = own.select("id", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    best = F.max("score").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return top.withColumn("best", best).where((F.col("score") >= floor) & (F.col("score") >= F.round(F.col("best") - margin, 6))).drop("best")


def unit_vectors(vectors: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """The vectors (id, embedding) fit to be stored: finite and of length one, within the tolerance."""
    squares = F.aggregate(F.transform("embedding", lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return vectors.where(F.coalesce(F.abs(F.sqrt(squares) - 1) <= tolerance, F.lit(False)))


def symbol_anchors(g: Graph, query: str, limit: int) -> DataFrame:
    """(id, name, path, line, kind, exact, score): symbols whose name or path the query names, by how closely."""
    q, tokens = query.strip().lower(), [t for t in p.normalised(query).split() if len(t) >= 2]
    files = g.file.select(F.col("id").alias("file_id"), "path")
    n = g.node.where("kind not in ('FILE', 'UNKNOWN', 'BUILTIN_TYPE')").join(files, "file_id")
    name, path = F.lower("serialized_name"), F.lower("path")
    score = F.lit(0.70) + F.when(name == q, 0.22).when(name.contains(q), 0.14).otherwise(0.0) + F.when(path == q, 0.08).when(path.contains(q), 0.04).otherwise(0.0)
    hit = name.contains(q) | (path == q)
    for t in tokens:
        score = score + F.when(name == t, 0.05).when(name.contains(t), 0.03).otherwise(0.0) + F.when(path.contains(t), 0.01).otherwise(0.0)
        hit = hit | (name == t)
    s = n.where(hit).select("id", F.col("serialized_name").alias("name"), "path", F.col("start_line").alias("line"), "kind", (name == q).alias("exact"), F.round(F.least(score, F.lit(1.20)), 6).alias("score"))
    return s.orderBy(F.desc("score"), "path", "name", "line", "id").limit(limit)


def selected_anchors(anchors: DataFrame) -> DataFrame:
    """Of the first few anchors (id, path, exact, score, place) those to go on from: exact ones first, few a file."""
    window = anchors.where((F.col("place") <= ANCHOR_WINDOW) & F.col("id").isNotNull())
    order = [F.desc("exact"), F.col("place")]
    one = window.withColumn("_d", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_d = 1").drop("_d")
    few = one.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("_n") <= ANCHORS_A_FILE)
    return few.orderBy(*order).limit(ANCHORS).drop("_n")


def expansion(g: Graph, anchors: DataFrame, limit: int) -> DataFrame:
    """(id, score, via, kind, direction, fanout): neighbours of anchors (id, score) that are no anchors, each by its best way.

    A way is worth the anchor's score times the weight of its edge kind, less for an incoming one, for
    every further step and for anchors with many neighbours.
    """
    held = {r.id: min(max(r.score, 0.0), 1.0) for r in anchors.select("id", "score").collect()}
    ids, spark = list(held) or [-1], g.node.sparkSession
    # Anchors are few, so only what lies beside them is read.
    own = adjacency_of(g.edge)
    ends = lambda way: own.steps(way).at(ids).select(F.col("at").alias("via"), F.col("next").alias("id"), "kind", edge_weight().alias("weight"), F.lit(way).alias("direction"))
    both = ends("outgoing").unionByName(ends("incoming")).where((F.col("weight") > 0) & ~F.col("id").isin(ids))
    worth = spark.createDataFrame([(i, float(v)) for i, v in held.items()], "via long, worth double")
    near = both.join(F.broadcast(worth), "via")
    fan = near.groupBy("via").agg(F.count_distinct("id").alias("fanout"))
    score = F.col("worth") * F.col("weight") * F.when(F.col("direction") == "outgoing", 1.0).otherwise(0.9) / (F.lit(2) * F.sqrt(F.lit(1.0) + F.col("fanout")))
    scored = near.join(F.broadcast(fan), "via").withColumn("score", F.round(F.least(score, F.lit(1.0)), 6))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "via", "direction", "kind", "fanout")).alias("b"))
    return best.select("id", (-F.col("b.s")).alias("score"), "b.via", "b.kind", "b.direction", "b.fanout").orderBy(F.desc("score"), "id").limit(limit)


def with_ranks(lane: DataFrame, *order: str) -> DataFrame:
    """A bounded lane with ``rank`` from 1, by score and then the columns of ``order``."""
    return lane.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *order)))


def missing_ranks(lane: DataFrame) -> DataFrame:
    """A lane (path, symbol, line, score, rank) whose hits without a rank follow the last ranked one, by score, path, symbol and line."""
    last = F.coalesce(F.max("rank").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    n = F.row_number().over(Window.partitionBy(F.col("rank").isNull()).orderBy(F.desc("score"), F.asc_nulls_first("path"), F.asc_nulls_first("symbol"), F.asc_nulls_first("line")))
    return lane.withColumns({"_last": last, "_n": n}).withColumn("rank", F.coalesce("rank", F.col("_last") + F.col("_n"))).drop("_last", "_n")


def merged(lanes: dict[str, DataFrame]) -> DataFrame:
    """Candidates of lanes (node_id, path, symbol, line, kind, exact, score, rank) as one row an identity.

    A candidate is a node, or else a place (path, symbol, line). Attributes that one lane lacks come from another.
    """
    columns = ["node_id", "path", "symbol", "line", "kind", "exact", "score", "rank"]
    rows = reduce(DataFrame.unionByName, [df.select(*columns).withColumn("lane", F.lit(name)) for name, df in lanes.items()])
    identity = F.when(F.col("node_id").isNotNull(), F.concat(F.lit("n"), F.col("node_id").cast("string"))).otherwise(F.concat_ws("|", F.lit("p"), "path", F.coalesce("symbol", F.lit("")), F.coalesce(F.col("line").cast("string"), F.lit(""))))
    fill = [F.min(c).alias(c) for c in ("node_id", "path", "symbol", "line", "kind")] + [F.max(F.coalesce("exact", F.lit(False))).alias("exact")]
    own = [F.max(F.when(F.col("lane") == x, F.col("score"))).alias(f"{x}_score") for x in lanes] + [F.min(F.when(F.col("lane") == x, F.col("rank"))).alias(f"{x}_rank") for x in lanes]
    return rows.groupBy(identity.alias("identity")).agg(*fill, *own)


def search_role(path: Column, symbol: Column) -> Column:
    """The role of a hit: that of a test scope in its name, of prose by its ending, else of its path."""
    name = F.coalesce(symbol, F.lit(""))
    return F.when(name.rlike("(^|::)tests?::"), "test").when(extension(path).isin("md", "mdx", "rst"), "docs").otherwise(file_role(path))


def definition_quality(kind: Column, named: Column) -> Column:
    quality = F.when(kind.isin(*TYPES, "FUNCTION", "METHOD", *MODULES), 1.0).when(kind.isin("ANNOTATION", *DATA), 0.65).when(kind == "TYPE_PARAMETER", 0.45).when(kind == "MACRO", 0.25).otherwise(0.0)
    return F.when(named, quality).otherwise(0.0)


def _asks(role: str, tokens: list[str]) -> bool:
    return bool(set(ASKED.get(role, "").split()) & set(tokens))


def role_quality(role: Column, tokens: list[str]) -> Column:
    """How good a text of that role answers, whole where the query asks for the role."""
    plain = {"entrypoint": 1.0, "source": 0.80, "docs": 0.35, "benchmark": 0.20}
    out = F.lit(0.0)
    for r in ("entrypoint", "source", *ASKED):
        out = F.when(role == r, 1.0 if _asks(r, tokens) else plain.get(r, 0.0)).otherwise(out)
    return out


def primary_only(candidates: DataFrame, tokens: list[str]) -> DataFrame:
    """Candidates (role, exact) without tests, benchmarks, generated and vendored ones that were not asked for, unless there is nothing else."""
    off = [r for r in ("test", "benchmark", "generated", "vendor")]
    other = F.col("role").isin(*off)
    unasked = F.col("role").isin(*[r for r in off if not _asks(r, tokens)] or ["-"])
    some = F.max((~other).cast("int")).over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) == 1
    return candidates.withColumn("_some", some).where(~F.col("_some") | ~unasked | F.col("exact")).drop("_some")


def without_phantoms(candidates: DataFrame) -> DataFrame:
    return candidates.where(~F.col("path").rlike("^(lexical|semantic|scip):"))


def ranked(candidates: DataFrame, features: p.Features, limit: int) -> DataFrame:
    """The final order of merged candidates: a uniquely named definition first, then by score, role, path, name, line and node.

    The score adds the fused ranks, support in the graph, the quality of the text, agreement with the
    roles that the query asks for, and the share of its tokens in path and name.
    """
    tokens = [t.lower() for t in __import__("re").split(r"[\W_]+", features.query) if len(t) >= 2]
    c = without_phantoms(candidates).withColumn("role", search_role(F.col("path"), F.col("symbol")))
    c = primary_only(c, tokens)
    path, symbol = F.lower("path"), F.lower(F.coalesce("symbol", F.lit("")))
    share = lambda found, n: reduce(Column.__add__, [x.cast("int") for x in found]) / F.lit(float(n)) if n else F.lit(0.0)
    overlap = share([path.contains(t) | symbol.contains(t) for t in tokens], len(tokens))
    asked = features.roles + features.structures
    agreement = share([path.contains(t) | symbol.contains(t) | (F.lower(F.coalesce("kind", F.lit(""))) == t) for t in asked], len(asked))
    named = F.col("symbol").isNotNull() & F.col("node_id").isNotNull() & F.col("line").isNotNull()
    text = F.lit(0.75) * role_quality(F.col("role"), tokens) + F.lit(0.25) * definition_quality(F.col("kind"), named)
    fused = reciprocal([F.col(f"{x}_rank") for x in ("lexical", "semantic", "graph")], p.LANE_WEIGHTS[features.shape])
    graph = F.least(F.greatest(F.coalesce("graph_score", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    score = F.round(F.lit(FUSED) * fused + F.lit(GRAPH) * graph + F.lit(TEXT) * text + F.lit(ROLE) * agreement + F.lit(OVERLAP) * overlap, 6)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exact_nodes = F.size(F.collect_set(F.when(F.col("exact"), F.col("node_id"))).over(whole))
    c = c.withColumns({"score": score, "pinned": F.coalesce(F.col("exact") & F.col("node_id").isNotNull() & (exact_nodes == 1), F.lit(False))})
    order = [F.desc("pinned"), F.desc("score"), role_rank(F.col("role")), F.asc_nulls_first("path"), F.asc_nulls_first("symbol"), F.asc_nulls_first("line"), F.asc_nulls_first("node_id")]
    top = c.orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order))).select("place", "node_id", "path", "symbol", "kind", "role", "score", "pinned")


def match_quality(query: str, name: Column) -> Column:
    """How a hit's name answers the query: exact, normalized_exact, prefix, or fuzzy."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"[\s_\-]+", ""))
    q = "".join(c for c in query.strip().lower() if not c.isspace() and c not in "_-")
    whole, last, first = squeeze(name), squeeze(F.element_at(F.split(name, r"::|\.|#"), -1)), squeeze(F.element_at(F.split(name, r"::|\.|#"), 1))
    same = (whole == q) | (last == q) | (first == q)
    starts = whole.startswith(q) | last.startswith(q) | first.startswith(q)
    return F.when(name == query.strip(), "exact").when(same, "normalized_exact").when(starts, "prefix").otherwise("fuzzy")


#: Kinds that an alias in a filter stands for.
KIND_ALIASES = {"fn": ("FUNCTION",), "func": ("FUNCTION",), "function": ("FUNCTION",), "method": ("METHOD",), "callable": CALLABLES, "type": TYPES, "var": ("VARIABLE", "GLOBAL_VARIABLE"), "variable": ("VARIABLE", "GLOBAL_VARIABLE"), "global": ("GLOBAL_VARIABLE",), "const": ("CONSTANT",), "field": ("FIELD",), "member": ("FIELD",), "file": ("FILE",)}


def passes(intent: p.Intent) -> Column:
    """Whether a hit (kind, path, name) passes all filters of an intent."""
    from loomgraph.functions.paths import PARSED, STRUCTURAL

    out = F.lit(True)
    for name, value in intent.filters:
        v = value.lower()
        if name == "kind":
            own = F.lower(F.translate(F.col("kind"), "_", "")) == v.replace("_", "")
            one = own | F.col("kind").isin(*KIND_ALIASES.get(v, ("-",)))
        elif name == "path":
            one = F.lower(F.coalesce("path", F.lit(""))).contains(v)
        elif name == "name":
            one = F.lower("name").contains(v) | F.lower(F.regexp_replace("name", r"[\s_\-]+", "")).contains("".join(c for c in v if c not in "_- "))
        else:
            endings = (PARSED | STRUCTURAL).get(v, v.lstrip(".")).split()
            one = extension(F.coalesce("path", F.lit(""))).isin(*endings)
        out = out & one
    return out


@dataclass
class Corpus:
    """What a search runs over: the lexical index, the graph, and vectors (id, embedding) of its nodes."""

    index: Index
    graph: Graph
    vectors: DataFrame


def search(corpus: Corpus, query: str, query_vector: list[float] | None, limit: int = 20) -> DataFrame:
    """Ranked hits of all lanes that the plan of the query asks for."""
    features = p.classify(query)
    stages = dict(p.plan(features))
    g = corpus.graph
    none = F.lit(None)
    shape = lambda df: df.select("node_id", "path", "symbol", "line", "kind", "exact", "score", "rank")
    lanes: dict[str, DataFrame] = {}
    semantic = lambda: local(with_ranks(local(cosine_top(corpus.vectors, query_vector, stages["semantic"])), "id").select(F.col("id").alias("node_id"), "score", "rank"))  # type: ignore[arg-type]
    asked = "semantic" in stages and bool(query_vector)
    # A definition asked for by a name that one symbol has needs no neighbours and nothing like it, so that is looked at first.
    early = asked and features.mode != "definition"
    hits, anchors, near = together(
        lambda: local(lexical_search(corpus.index, query, max(limit, ANCHOR_WINDOW))), lambda: local(symbol_anchors(g, query, stages.get("anchor", 8))), semantic if early else lambda: None,
    )
    lanes["lexical"] = shape(hits.withColumns({"exact": F.lit(False), "rank": F.col("place")}))
    if features.mode == "definition" and anchors.where("exact").limit(2).count() == 1:
        stages = {k: n for k, n in stages.items() if k not in ("semantic", "expand")}
        asked = False
    seeds = anchors.select("id", "path", "exact", "score", F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("score"), "path", "id")).alias("place"))
    expand = lambda: local(expansion(g, selected_anchors(seeds).select("id", "score"), stages["expand"]).select(F.col("id").alias("node_id"), "score"))
    spread, near = together(expand if "expand" in stages else lambda: None, semantic if asked and not early else lambda: near)
    # What both lists name is looked up at once.
    ids = reduce(DataFrame.unionByName, [df.select("node_id") for df in (spread, near) if df is not None], anchors.select(F.col("id").alias("node_id")).limit(0)).distinct()
    files = g.file.select(F.col("id").alias("file_id"), "path")
    named = g.node.select(F.col("id").alias("node_id"), F.col("serialized_name").alias("symbol"), F.col("start_line").alias("line"), "kind", "file_id").join(F.broadcast(ids), "node_id")
    where = local(named.join(files, "file_id").select("node_id", "path", "symbol", "line", "kind")) if spread is not None or near is not None else None
    columns = ["node_id", "path", "symbol", "line", "kind", "exact", "score"]
    graph = anchors.select(F.col("id").alias("node_id"), "path", F.col("name").alias("symbol"), "line", "kind", "exact", "score").select(*columns)
    if near is not None:
        lanes["semantic"] = shape(where.join(near, "node_id").withColumn("exact", F.lit(False)))
    if spread is not None:
        graph = graph.unionByName(where.join(spread, "node_id").withColumn("exact", F.lit(False)).select(*columns))
    lanes["graph"] = shape(with_ranks(graph, "path", "symbol", "line", "node_id"))
    if "semantic" not in lanes:
        lanes["semantic"] = lanes["lexical"].where(F.lit(False)).withColumns({"score": none.cast("double"), "rank": none.cast("int")})
    return ranked(merged(lanes), features, limit)


def together(*actions: Callable[[], T]) -> list[T]:
    """What each action gives; their jobs run side by side."""
    out: list = [None] * len(actions)
    failed: list[BaseException] = []

    def run(i: int, action: Callable[[], T]) -> None:
        try:
            out[i] = action()
        except BaseException as e:  # told to the caller below
            failed.append(e)

    threads = [InheritableThread(target=run, args=(i, a)) for i, a in enumerate(actions)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if failed:
        raise failed[0]
    return out
