"""Search lanes, fusion and final order, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.graph import display_name
from loomgraph.operators import search as s
from loomgraph.plans import planner as p
from loomgraph.plans.fragments import EFFECTIVE, ROLE, role
from loomgraph.sources.star_schema import BASE, load_graph, table
from loomgraph.sources.store import kept, stored, tasks_for

QUERY, TEXT_QUERY, MIXED_QUERY = "supplier#000000001", "thing attion order", "order_77 run supplier"
_TOKENS = p.query_tokens(TEXT_QUERY)
DOCUMENT_TERMS = 250
FEATURE_QUERIES = ("Supplier#000000001", "src/core/nation_0.rs", "how does the order flow through the store", "resolve_target", "`lyon`", "where is OrderBook::run used", "licensed")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sources and the larger symbols as symbol documents."""
    g = load_graph(spark, sf_dir)
    d = table(spark, sf_dir, "documents")
    none = F.lit(None)
    docs = d.select(F.col("doc_id").alias("key"), F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt")).alias("path"), F.col("text").alias("content"), none.cast("string").alias("symbol"), none.cast("long").alias("node_id"), none.cast("string").alias("kind"), none.cast("long").alias("line"), F.lit(0).alias("source"))
    n = g.node.where("kind in ('CLASS', 'STRUCT', 'METHOD')").join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id")
    return docs.unionByName(n.select(F.col("id").alias("key"), "path", F.concat_ws(" ", "kind", "serialized_name").alias("content"), F.col("qualified_name").alias("symbol"), F.col("id").alias("node_id"), "kind", F.col("start_line").alias("line"), F.lit(1).alias("source")))


def lexical_index(spark: SparkSession, sf_dir: str) -> s.Index:
    """The stored index of a folder of tables, built on first use."""

    def build() -> s.Index:
        # A symbol has a few terms, a document hundreds.
        terms = 5 * load_graph(spark, sf_dir).node.count() + DOCUMENT_TERMS * table(spark, sf_dir, "documents").count()
        built = s.build_index(_texts(spark, sf_dir), tasks_for(spark, terms))
        index = s.Index(stored(built.docs, "key"), stored(built.postings))
        index.size()
        return index

    return kept(spark, f"lexical:{sf_dir}", build)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the classes with the same number."""
    return table(spark, sf_dir, "embeddings").select((F.lit(3 * BASE) + F.col("vec_id")).alias("id"), "embedding")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return [float(x) for x in _vectors(spark, sf_dir).where(F.col("id") == 3 * BASE).first()["embedding"]]


def _dense(spark: SparkSession, sf_dir: str, floor: float = 0.30, margin: float = 0.10) -> DataFrame:
    return s.cosine_top(_vectors(spark, sf_dir).where(F.col("id") != 3 * BASE), _query_vector(spark, sf_dir), 40, floor, margin)


def _search(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir).where(F.col("id") != 3 * BASE)
    return s.search(s.Corpus(lexical_index(spark, sf_dir), load_graph(spark, sf_dir), vectors), query, _query_vector(spark, sf_dir), 20)


def _seeds(g) -> DataFrame:  # noqa: ANN001
    from pyspark.sql import Window

    a = s.symbol_anchors(g, QUERY, 24)
    return s.selected_anchors(a.withColumn("place", F.row_number().over(Window.orderBy(F.desc("exact"), F.desc("score"), "path", "id"))))


def _expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load_graph(spark, sf_dir)
    return s.expansion(g, _seeds(g).select("id", "score"), 50)


def _intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load_graph(spark, sf_dir)
    n = g.node.select("id", "kind", display_name().alias("name"), "file_id").join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id")
    return n.where(s.passes(p.parse_intent("kind:type path:core name:000 lang:rust book"))).select("id", "kind", "name", "path")


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load_graph(spark, sf_dir).node.where("kind in ('STRUCT', 'METHOD')").select("id", F.col("serialized_name").alias("name"))
    return n.select("id", s.match_quality("order_7", F.col("name")).alias("quality"))


def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load_graph(spark, sf_dir)
    c = g.node.where("kind = 'STRUCT'").join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "path", s.search_role(F.col("path"), F.col("qualified_name")).alias("role"), (F.col("id") % 37 == 0).alias("exact"))
    return s.primary_only(c, ["vendor", "ring"]).select("id", "role")


def _phantoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = load_graph(spark, sf_dir).file
    return s.without_phantoms(f.select("id", F.when(F.col("id") % 3 == 0, F.concat(F.lit("lexical:"), "path")).when(F.col("id") % 7 == 0, F.concat(F.lit("scip:"), "path")).otherwise(F.col("path")).alias("path")))


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load_graph(spark, sf_dir).node.where("kind = 'STRUCT'")
    i = F.col("id")
    lane = n.select("id", F.col("serialized_name").alias("symbol"), F.concat(F.lit("p"), i % 9).alias("path"), F.col("start_line").alias("line"), (i % 5 / 5).alias("score"), F.when(i % 4 == 0, (i % 1000).cast("int")).alias("rank"))
    return s.missing_ranks(lane).select("id", F.col("rank").cast("long").alias("rank"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search of symbol names alone: the best by their content lane."""
    index = lexical_index(spark, sf_dir)
    tokens = p.query_tokens("supplier customer")
    found = s.matches(index, tokens)
    return found.where("source = 1").select("key", s.bm25(s.totals(index, tokens, found), 0.0, 1.0).alias("score")).orderBy(F.desc("score"), "key").limit(20)


def _rough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of bytes with a factor that takes all vectors, so that the result is exact."""
    from loomgraph.operators.ranks import prefiltered_top

    return prefiltered_top(_vectors(spark, sf_dir).where(F.col("id") != 3 * BASE), _query_vector(spark, sf_dir), 15)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for q in FEATURE_QUERIES:
        f = p.classify(q)
        rows += [(q, f.shape, f.mode, k, stage, n) for k, (stage, n) in enumerate(p.plan(f))]
    return spark.createDataFrame(rows, "query string, shape string, mode string, ord int, stage string, n int")


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = r"trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WORDS = f"list_filter(string_split({_NORMAL}, ' '), lambda x: x <> '')"
_SYMBOL_WORDS = _WORDS.format("coalesce(symbol, '')")
_DOCS = f"""
docs0 AS (
  SELECT doc_id AS key, concat_ws('/', source, lang, doc_id) || '.txt' AS path, coalesce(text, '') AS content, CAST(NULL AS VARCHAR) AS symbol, CAST(NULL AS BIGINT) AS node_id, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS BIGINT) AS line, 0 AS source FROM documents
  UNION ALL SELECT n.id, f.path, n.kind || ' ' || serialized_name, qualified_name, n.id, n.kind, start_line, 1 FROM node n JOIN file f ON f.id = n.file_id WHERE n.kind IN ('CLASS', 'STRUCT', 'METHOD')),
docs AS (SELECT *, {_WORDS.format('path')} AS pt, {_WORDS.format('content')} AS ct FROM docs0)"""


def _lanes(query: str, limit: int) -> str:
    """The lanes of a query as SQL, the stages as named tables."""
    tokens, quoted = p.query_tokens(query), p.quoted_tokens(query)
    most = max(256, min(64 * limit, p.LEXICAL_WINDOW))
    count = lambda column, t: f"len(list_filter({column}, lambda x: starts_with(x, '{t}')))"
    counts = ", ".join(f"{count('pt', t)} AS p{k}, {count('ct', t)} AS c{k}" for k, t in enumerate(tokens))
    some = " + ".join(f"p{k} + c{k}" for k in range(len(tokens)))

    def score(a: str, b: str) -> str:
        parts = []
        for k in range(len(tokens)):
            tf = f"(p{k} * {a}e0 + c{k} * {b}e0)"
            parts.append(f"greatest(ln((n - d{k} + 0.5e0) / (d{k} + 0.5e0)), 1e-6) * {tf} * 2.2e0 / ({tf} + 1.2e0 * (0.25e0 + 0.75e0 * (len(pt) + len(ct)) / mean))")
        return f"round(0e0 + {' + '.join(parts)}, 6)"

    weight = lambda k, t: f"{'2e0 * ' if t in quoted else ''}least(5e0, greatest(0.25e0, 1e0 + ln((n + 1e0) / (d{k} + 1e0))))"
    overlap = " + ".join(f"CASE WHEN list_contains({_SYMBOL_WORDS}, '{t}') THEN {weight(k, t)} ELSE 0e0 END" for k, t in enumerate(tokens))
    needle = _sql_text(query.strip().lower())
    w = p.SUBLANE_WEIGHTS[p.classify(query).shape]
    rrf = " + ".join(f"coalesce({a}e0 / (20 + {x}_rank), 0e0)" for x, a in zip(s.LANES, w))
    matched = " + ".join(f"CASE WHEN p{k} + c{k} > 0 THEN 1 ELSE 0 END" for k in range(len(tokens)))
    must = " AND ".join([f"p{k} + c{k} > 0" for k, t in enumerate(tokens) if t in quoted] or ["true"])
    return f"""{_DOCS},
cnt AS (SELECT *, {counts} FROM docs),
tot AS (SELECT count(*) AS n, avg(len(pt) + len(ct)) AS mean, {', '.join(f'count(*) FILTER (p{k} + c{k} > 0) AS d{k}' for k in range(len(tokens)))} FROM cnt),
mt AS (SELECT cnt.*, tot.*, {score('8', '1')} AS by_path, {score('1', '4')} AS by_content FROM cnt, tot WHERE {some} > 0),
sy0 AS (SELECT *, round({overlap}, 6) AS overlap FROM (SELECT * FROM mt WHERE source = 1 ORDER BY by_content DESC, path, key LIMIT {most})),
lanes AS (
  SELECT key, 'exact' AS lane, row_number() OVER (ORDER BY path, key) AS rank FROM docs WHERE lower(path) = {needle} OR lower(symbol) = {needle} OR ends_with(lower(symbol), '::' || {needle}) OR ends_with(lower(symbol), '.' || {needle}) QUALIFY rank <= {most}
  UNION ALL SELECT key, 'path', row_number() OVER (ORDER BY by_path DESC, path, key) AS rank FROM mt QUALIFY rank <= {most}
  UNION ALL SELECT key, 'content', row_number() OVER (ORDER BY by_content DESC, path, key) AS rank FROM mt QUALIFY rank <= {most}
  UNION ALL SELECT key, 'symbol', row_number() OVER (ORDER BY overlap DESC, by_content DESC, path, key) AS rank FROM sy0),
il AS (SELECT key, row_number() OVER (ORDER BY t, rank, l) AS position FROM (SELECT key, CASE WHEN lane = 'exact' THEN 0 ELSE 1 END AS t, rank, list_position(['exact','path','content','symbol'], lane) AS l FROM lanes QUALIFY row_number() OVER (PARTITION BY key ORDER BY t, rank, l) = 1)),
sr AS (SELECT key, {', '.join(f"min(rank) FILTER (lane = '{x}') AS {x}_rank" for x in s.LANES)} FROM lanes GROUP BY key),
fu AS (SELECT key, position, round(({rrf}) / ({sum(w)}e0 / 21e0), 6) AS score FROM sr JOIN il USING (key)),
lx AS (SELECT key, path, symbol, node_id, kind, line, {matched} AS matched, score, CAST(row_number() OVER (ORDER BY score DESC, position) AS INTEGER) AS place FROM mt JOIN fu USING (key) WHERE {matched} >= {p.required_matches(len(tokens))} AND {must} QUALIFY place <= {limit})"""


def _dense_sql(floor: float = 0.30, margin: float = 0.10) -> str:
    return f"""
vq AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0),
top AS (SELECT 30000000000 + vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings, vq WHERE vec_id <> 0 ORDER BY score DESC, id LIMIT 40),
dense AS (SELECT id, score FROM top WHERE score >= {floor} AND score >= round((SELECT max(score) FROM top) - {margin}, 6))"""


def _anchor_sql(limit: int, query: str = QUERY) -> str:
    q = query.lower()
    tokens = [t for t in p.normalised(q).split() if len(t) >= 2]
    extra = "".join(f" + CASE WHEN lower(serialized_name) = '{t}' THEN 0.05e0 WHEN contains(lower(serialized_name), '{t}') THEN 0.03e0 ELSE 0e0 END + CASE WHEN contains(lower(path), '{t}') THEN 0.01e0 ELSE 0e0 END" for t in tokens)
    hit = "".join(f" OR lower(serialized_name) = '{t}'" for t in tokens)
    return f"""an AS (SELECT n.id, serialized_name AS name, path, start_line AS line, kind, lower(serialized_name) = '{q}' AS exact,
  round(least(0.70e0 + CASE WHEN lower(serialized_name) = '{q}' THEN 0.22e0 WHEN contains(lower(serialized_name), '{q}') THEN 0.14e0 ELSE 0e0 END + CASE WHEN lower(path) = '{q}' THEN 0.08e0 WHEN contains(lower(path), '{q}') THEN 0.04e0 ELSE 0e0 END{extra}, 1.20e0), 6) AS score
  FROM node n JOIN file f ON f.id = n.file_id WHERE kind <> 'FILE' AND (contains(lower(serialized_name), '{q}') OR lower(path) = '{q}'{hit}) ORDER BY score DESC, path, name, line, n.id LIMIT {limit}),
pl AS (SELECT *, row_number() OVER (ORDER BY exact DESC, score DESC, path, id) AS place FROM an),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY exact DESC, place) AS pn FROM pl WHERE place <= 24) WHERE pn <= 2 ORDER BY exact DESC, place LIMIT 8)"""


def _expansion_sql(limit: int) -> str:
    weight = "CASE kind WHEN 'CALL' THEN 1.0e0 WHEN 'INHERITANCE' THEN 0.9e0 WHEN 'TYPE_USAGE' THEN 0.8e0 WHEN 'USAGE' THEN 0.75e0 WHEN 'IMPORT' THEN 0.6e0 ELSE 0e0 END"
    return f"""ew AS (SELECT src, dst, kind, {weight} AS weight FROM eff WHERE src <> dst),
bo AS (SELECT src AS via, dst AS id, kind, weight, 'outgoing' AS direction FROM ew WHERE weight > 0 UNION ALL SELECT dst, src, kind, weight, 'incoming' FROM ew WHERE weight > 0),
nr AS (SELECT bo.*, greatest(least(sel.score, 1e0), 0e0) AS worth FROM bo JOIN sel ON sel.id = bo.via WHERE bo.id NOT IN (SELECT id FROM sel)),
fn AS (SELECT via, count(DISTINCT id) AS fanout FROM nr GROUP BY via),
ex AS (SELECT id, round(least(worth * weight * CASE WHEN direction = 'outgoing' THEN 1.0e0 ELSE 0.9e0 END / (2 * sqrt(1e0 + fanout)), 1e0), 6) AS score, via, kind, direction, fanout FROM nr JOIN fn USING (via) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, via, direction, kind, fanout) = 1 ORDER BY score DESC, id LIMIT {limit})"""


def _ranked_sql(query: str, alone: bool = False) -> str:
    """The whole of a search; ``alone`` where one symbol has the name asked for, so that neighbours and likenesses are left out."""
    f = p.classify(query)
    stages = dict(p.plan(f))
    tokens = [t for t in __import__("re").split(r"[\W_]+", f.query.lower()) if len(t) >= 2]
    share = " + ".join(f"CASE WHEN contains(lower(path), '{t}') OR contains(lower(coalesce(symbol, '')), '{t}') THEN 1 ELSE 0 END" for t in tokens)
    w = p.LANE_WEIGHTS[f.shape]
    rrf = " + ".join(f"CASE WHEN {x}_rank IS NOT NULL THEN {a}e0 / (20 + greatest({x}_rank, 1)) ELSE 0e0 END" for x, a in zip(("lexical", "semantic", "graph"), w) if a > 0)
    lane = lambda x: f"max(score) FILTER (lane = '{x}') AS {x}_score, min(rank) FILTER (lane = '{x}') AS {x}_rank"
    found = f"CASE WHEN regexp_matches(coalesce(symbol, ''), '(^|::)tests?::') THEN 'test' WHEN regexp_matches(lower(path), '\\.(md|mdx|rst)$') THEN 'docs' ELSE {role('path')} END"
    quality = "CASE WHEN symbol IS NOT NULL AND node_id IS NOT NULL AND line IS NOT NULL THEN CASE WHEN kind IN ('CLASS','STRUCT','METHOD','MODULE','NAMESPACE') THEN 1e0 WHEN kind = 'FIELD' THEN 0.65e0 ELSE 0e0 END ELSE 0e0 END"
    return f"""WITH GRAPH, {EFFECTIVE}, {_lanes(query, 24)}, {_dense_sql(9.0 if alone else 0.30)}, {_anchor_sql(stages.get('anchor', 8), query)}, {_expansion_sql(0 if alone else stages['expand'])},
wh AS (SELECT n.id AS node_id, path, serialized_name AS symbol, start_line AS line, kind FROM node n JOIN file f ON f.id = n.file_id),
gr0 AS (SELECT id AS node_id, path, name AS symbol, line, kind, exact, score FROM an UNION ALL SELECT node_id, path, symbol, line, wh.kind, false, score FROM ex JOIN wh ON wh.node_id = ex.id),
gr AS (SELECT *, row_number() OVER (ORDER BY score DESC, path, symbol, line, node_id) AS rank FROM gr0),
se AS (SELECT id AS node_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM dense),
al AS (SELECT node_id, path, symbol, line, kind, false AS exact, score, place AS rank, 'lexical' AS lane FROM lx UNION ALL SELECT node_id, path, symbol, line, kind, false, score, rank, 'semantic' FROM se JOIN wh USING (node_id) UNION ALL SELECT node_id, path, symbol, line, kind, exact, score, rank, 'graph' FROM gr),
me AS (SELECT CASE WHEN node_id IS NOT NULL THEN 'n' || node_id ELSE concat_ws('|', 'p', path, coalesce(symbol, ''), coalesce(CAST(line AS VARCHAR), '')) END AS identity, min(node_id) AS node_id, min(path) AS path, min(symbol) AS symbol, min(line) AS line, min(kind) AS kind, bool_or(exact) AS exact, {lane('lexical')}, {lane('semantic')}, {lane('graph')} FROM al GROUP BY 1),
ro AS (SELECT *, {found} AS role FROM me WHERE NOT regexp_matches(path, '^(lexical|semantic|scip):')),
pr AS (SELECT * FROM ro WHERE (SELECT count(*) FROM ro WHERE role NOT IN ('test','benchmark','generated','vendor')) = 0 OR role NOT IN ('test','benchmark','generated','vendor') OR exact),
sc AS (SELECT *, round(0.70e0 * round(({rrf}) / ({sum(w)}e0 / 21e0), 6) + 0.15e0 * least(greatest(coalesce(graph_score, 0e0), 0e0), 1e0) + 0.05e0 * (0.75e0 * CASE role WHEN 'entrypoint' THEN 1e0 WHEN 'source' THEN 0.8e0 WHEN 'docs' THEN 0.35e0 WHEN 'benchmark' THEN 0.2e0 ELSE 0e0 END + 0.25e0 * {quality}) + 0.05e0 * 0e0 + 0.05e0 * (({share}) / {len(tokens)}e0), 6) AS score, coalesce(exact AND node_id IS NOT NULL AND (SELECT count(DISTINCT node_id) FROM pr WHERE exact) = 1, false) AS pinned FROM pr)
SELECT CAST(row_number() OVER (ORDER BY pinned DESC, score DESC, list_position(['entrypoint','source','test','docs','benchmark','generated','vendor'], role), path NULLS FIRST, symbol NULLS FIRST, line NULLS FIRST, node_id NULLS FIRST) AS INTEGER) AS place, node_id, path, symbol, kind, role, score, pinned FROM sc QUALIFY place <= 20"""


def _features_sql() -> str:
    """Expected readings, written down by hand."""
    lex, sem = ("lexical", 4096), ("semantic", 64)
    expected = {
        FEATURE_QUERIES[0]: ("symbol_like", "definition", [("anchor", 8), lex, ("expand", 12), sem]), FEATURE_QUERIES[1]: ("path_like", "definition", [("anchor", 8), lex, ("expand", 8)]),
        FEATURE_QUERIES[2]: ("natural_language", "ordered_flow", [lex, sem, ("expand", 20)]), FEATURE_QUERIES[3]: ("symbol_like", "definition", [("anchor", 8), lex, ("expand", 12), sem]),
        FEATURE_QUERIES[4]: ("symbol_like", "definition", [("anchor", 8), lex, ("expand", 12), sem]), FEATURE_QUERIES[5]: ("mixed", "relation", [("anchor", 8), lex, sem, ("expand", 16)]), FEATURE_QUERIES[6]: ("natural_language", "explanation", [lex, sem, ("expand", 20)]),
    }
    rows = [f"({_sql_text(q)}, '{shape}', '{mode}', {k}, '{stage}', {n})" for q, (shape, mode, stages) in expected.items() for k, (stage, n) in enumerate(stages)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) t(query, shape, mode, ord, stage, n)"


_LX = f"WITH GRAPH, {_lanes(TEXT_QUERY, 20)}"
ALL = {
    "document_frequency": (lambda x, d: s.document_frequencies(lexical_index(x, d), _TOKENS), f"{_LX} " + " UNION ALL ".join(f"SELECT '{t}' AS token, d{k} AS n FROM tot WHERE d{k} > 0" for k, t in enumerate(_TOKENS))),
    "lexical_lanes": (lambda x, d: s.lexical_lanes(lexical_index(x, d), TEXT_QUERY, 20), f"{_LX} SELECT key, lane, CAST(rank AS INTEGER) AS rank FROM lanes"),
    "interleaved_lanes": (lambda x, d: s.interleaved(s.lexical_lanes(lexical_index(x, d), TEXT_QUERY, 20)), f"{_LX} SELECT key, CAST(position AS INTEGER) AS position FROM il"),
    "sublane_ranks": (lambda x, d: s.sublane_ranks(s.lexical_lanes(lexical_index(x, d), TEXT_QUERY, 20)), f"{_LX} SELECT * FROM sr"),
    "lexical_search": (lambda x, d: s.lexical_search(lexical_index(x, d), TEXT_QUERY, 20), f"{_LX} SELECT * FROM lx"),
    "exact_symbol_search": (lambda x, d: s.lexical_search(lexical_index(x, d), QUERY, 24), f"WITH GRAPH, {_lanes(QUERY, 24)} SELECT * FROM lx"),
    "excerpts": (lambda x, d: table(x, d, "documents").select("doc_id", s.excerpt(F.col("text"), ["thing", "attion"]).alias("e")).where("e is not null").select("doc_id", "e.line", "e.start", "e.excerpt"), "WITH a AS (SELECT doc_id, text, least(CASE WHEN strpos(lower(text), 'thing') > 0 THEN strpos(lower(text), 'thing') END, CASE WHEN strpos(lower(text), 'attion') > 0 THEN strpos(lower(text), 'attion') END) AS pos FROM documents), b AS (SELECT *, string_split(substr(text, 1, pos - 1), chr(10)) AS l FROM a WHERE pos IS NOT NULL) SELECT doc_id, len(l) AS line, pos AS start, right(l[-1], 192) || string_split(substr(text, pos, 320), chr(10))[1] AS excerpt FROM b"),
    "dense_search": (_dense, f"WITH {_dense_sql()} SELECT * FROM dense"),
    "cosine_top": (lambda x, d: _dense(x, d, -1.0, 3.0), f"WITH {_dense_sql()} SELECT * FROM top"),
    "unit_vectors": (lambda x, d: s.unit_vectors(_vectors(x, d)).select("id"), "SELECT 30000000000 + vec_id AS id FROM embeddings WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.001"),
    "symbol_anchors": (lambda x, d: s.symbol_anchors(load_graph(x, d), QUERY, 24), f"WITH GRAPH, {_anchor_sql(24)} SELECT id, name, path, line, kind, exact, score FROM an"),
    "selected_anchors": (lambda x, d: _seeds(load_graph(x, d)).select("id", "path", "score"), f"WITH GRAPH, {_anchor_sql(24)} SELECT id, path, score FROM sel"),
    "adjacency_expansion": (_expansion, f"WITH GRAPH, {EFFECTIVE}, {_anchor_sql(24)}, {_expansion_sql(50)} SELECT * FROM ex"),
    "hybrid_search": (lambda x, d: _search(x, d, MIXED_QUERY), _ranked_sql(MIXED_QUERY)),
    "definition_search": (lambda x, d: _search(x, d, QUERY), _ranked_sql(QUERY, alone=True)),
    "intent_filter": (_intent, "WITH GRAPH SELECT n.id, kind, qualified_name AS name, path FROM node n JOIN file f ON f.id = n.file_id WHERE kind IN ('CLASS', 'STRUCT') AND contains(lower(path), 'core') AND contains(lower(qualified_name), '000') AND path LIKE '%.rs'"),
    "match_quality": (_quality, "WITH GRAPH SELECT id, CASE WHEN serialized_name = 'order_7' THEN 'exact' WHEN replace(serialized_name, '_', '') = 'order7' THEN 'normalized_exact' WHEN starts_with(replace(serialized_name, '_', ''), 'order7') THEN 'prefix' ELSE 'fuzzy' END AS quality FROM node WHERE kind IN ('STRUCT', 'METHOD')"),
    "primary_roles": (_primary, f"WITH GRAPH, c AS (SELECT n.id, CASE WHEN path LIKE '%.md' THEN 'docs' ELSE {ROLE} END AS role, n.id % 37 = 0 AS exact FROM node n JOIN file f ON f.id = n.file_id WHERE n.kind = 'STRUCT') SELECT id, role FROM c WHERE role NOT IN ('test', 'benchmark', 'generated') OR exact"),
    "phantom_drop": (_phantoms, "WITH GRAPH SELECT id, path FROM file WHERE id % 3 <> 0 AND id % 7 <> 0"),
    "missing_ranks": (_missing, "WITH GRAPH, l AS (SELECT id, serialized_name AS symbol, 'p' || (id % 9) AS path, start_line AS line, id % 5 / 5e0 AS score, CASE WHEN id % 4 = 0 THEN id % 1000 END AS rank FROM node WHERE kind = 'STRUCT') SELECT id, coalesce(rank, (SELECT max(rank) FROM l) + row_number() OVER (PARTITION BY rank IS NULL ORDER BY score DESC, path NULLS FIRST, symbol NULLS FIRST, line NULLS FIRST)) AS rank FROM l"),
    "symbol_full_text": (_names, f"WITH GRAPH, {_lanes('supplier customer', 20)} SELECT key, round(0e0 + " + " + ".join(f"greatest(ln((n - d{k} + 0.5e0) / (d{k} + 0.5e0)), 1e-6) * c{k} * 2.2e0 / (c{k} + 1.2e0 * (0.25e0 + 0.75e0 * (len(pt) + len(ct)) / mean))" for k in range(2)) + ", 6) AS score FROM mt WHERE source = 1 ORDER BY score DESC, key LIMIT 20"),
    "prefiltered_top": (_rough, """WITH vq AS (SELECT q, list_transform(q, lambda x: round(127 * x / peak)) AS q8 FROM (SELECT q, list_max(list_transform(q, lambda x: abs(x))) AS peak FROM (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0))),
first AS (SELECT vec_id, embedding, q FROM embeddings, vq WHERE vec_id <> 0 ORDER BY list_dot_product(list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x * 127)), q8) DESC, vec_id LIMIT 60)
SELECT 30000000000 + vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), q), 6) AS score FROM first ORDER BY score DESC, id LIMIT 15"""),
    "query_plans": (_features, _features_sql()),
}
