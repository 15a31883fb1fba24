"""Ranks, targets, texts, citations, evidence joins, and stored generations, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.graph import display_name
from loomgraph.functions.paths import file_role
from loomgraph.operators import grams as gr
from loomgraph.operators import ranks as k
from loomgraph.operators import roots as ro
from loomgraph.plans.fragments import BAND, BENCH_PATH, ROLE, TEST_PATH, TIER
from loomgraph.plans.queries_inventory import ROOTS_SQL
from loomgraph.sources.publish import Publisher, flush
from loomgraph.sources.star_schema import Graph, load_graph, table
from loomgraph.sources.store import kept, shared_dir


def _g(f):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: f(load_graph(spark, sf_dir))


QUERY = "order_77"


def _hits(g: Graph) -> DataFrame:
    f = g.file.select(F.col("id").alias("file_id"), "path")
    n = g.node.where("kind in ('METHOD', 'CLASS', 'STRUCT')").join(f, "file_id")
    return n.select("id", F.col("serialized_name").alias("name"), "path", "kind", F.col("start_line").alias("line"))


def _search(g: Graph) -> DataFrame:
    keys = ro.root_keys(g).select("id", "entry", "place")
    degrees = ro.call_degrees(g)
    h = _hits(g).where("kind = 'METHOD'").join(keys, "id", "left").join(degrees, "id", "left").na.fill(0, ["entry", "callers", "callees"]).na.fill(3, ["place"])
    return k.by_rank(k.search_rank(QUERY, h), 40).select("id", "name", "position")


def _in_order(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is their position: where only the order counts, none are numbered in one task."""
    return df.withColumn("position", F.col(key))


def _merged(g: Graph) -> DataFrame:
    n = g.node.where("kind = 'STRUCT'").select("id", (F.col("id") % 13 / 13).alias("score"))
    return k.merged_by_node(_in_order(n.where("id % 3 <> 0"), "id"), _in_order(n.where("id % 2 = 0").withColumn("score", F.col("id") % 7 / 7), "id"))


def _inexact(g: Graph) -> DataFrame:
    f = g.file.select(F.col("id").alias("file_id"), "path")
    n = g.node.where("kind in ('METHOD', 'FIELD')")
    h = n.join(f, "file_id").select("id", F.col("serialized_name").alias("name"), "kind", "path")
    return k.unique_inexact("len", _in_order(h, "id"), n.count()).select("id", "name", "kind", "path")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.coalesce("lang", F.lit("x")), F.lit("/d"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("seq"))


def gram_index(spark: SparkSession, sf_dir: str) -> gr.GramIndex:
    return kept(spark, f"grams:{sf_dir}", lambda: gr.build_grams(_documents(spark, sf_dir)))


def name_index(spark: SparkSession, sf_dir: str) -> gr.NameIndex:
    return kept(spark, f"names:{sf_dir}", lambda: gr.build_names(load_graph(spark, sf_dir).node.where("kind in ('METHOD', 'STRUCT', 'CLASS', 'FILE')").select("id", F.col("serialized_name").alias("name"))))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gr.indexed_text_hits(gram_index(spark, sf_dir), "attion thing", ["attion", "thing", "thble", "ering"], 60)


def _fuzzy_sql(query: str, limit: int) -> str:
    """Every name folded by the same steps, character by character."""
    n = len(query)
    own = r"CASE WHEN regexp_matches(c, '^\s$') THEN 0 WHEN regexp_matches(c, '^[/,:;|]$') THEN 1 WHEN regexp_matches(c, '^\p{N}$') THEN 5 WHEN regexp_matches(c, '^\p{Lu}$') THEN 4 WHEN regexp_matches(c, '^\p{L}$') THEN 3 ELSE 2 END"
    place = "CASE WHEN own > 2 AND before <= 2 THEN CASE before WHEN 0 THEN 10 WHEN 1 THEN 9 ELSE 8 END WHEN (before = 3 AND own = 4) OR (before <> 5 AND own = 5) THEN 5 WHEN own = 2 THEN 8 WHEN own = 0 THEN 10 ELSE 0 END"
    q = "[" + ", ".join(f"'{c}'" for c in query) + "]"
    last = lambda what: f"coalesce(acc.{what}[j - 1], 0)"
    run = f"CASE WHEN e.place >= 8 AND e.place > {last('run')} THEN e.place ELSE {last('run')} END"
    joined, apart = f"{last('now')} + greatest(e.place, {run}, 4)", f"{last('past')} + e.place"
    now = f"CASE WHEN e.c = {q}[j] THEN greatest(CASE WHEN j = 1 THEN 16 + e.place * 2 ELSE 16 + greatest({joined}, {apart}) END, -1048576) ELSE -1048576 END"
    runs = f"CASE WHEN e.c = {q}[j] THEN CASE WHEN j > 1 AND {joined} >= {apart} THEN {run} ELSE e.place END ELSE 0 END"
    each = lambda x: f"list_transform(range(1, {n + 1}), lambda j: CAST({x} AS INTEGER))"
    none = "[" + ", ".join(["CAST(-1048576 AS INTEGER)"] * n) + "]"
    zero = "[" + ", ".join(["CAST(0 AS INTEGER)"] * n) + "]"
    return rf"""WITH GRAPH, names AS (SELECT DISTINCT serialized_name AS name FROM node WHERE kind IN ('METHOD', 'STRUCT', 'CLASS', 'FILE')),
ch AS (SELECT name, i, c, {own} AS own FROM (SELECT name, unnest(string_split(name, '')) AS c, generate_subscripts(string_split(name, ''), 1) AS i FROM names)),
pl AS (SELECT name, i, lower(c) AS c, {place} AS place FROM (SELECT *, coalesce(lag(own) OVER (PARTITION BY name ORDER BY i), 0) AS before FROM ch)),
l AS (SELECT name, list({{'c': c, 'place': place, 'best': -1048576, 'now': {none}, 'run': {zero}, 'past': {none}}} ORDER BY i) AS l FROM pl GROUP BY name),
f AS (SELECT name, list_reduce(l, lambda acc, e: {{'c': '', 'place': 0, 'best': greatest(acc.best, CAST(({now.replace('[j]', f'[{n}]').replace('[j - 1]', f'[{n - 1}]').replace('j = 1', 'false' if n > 1 else 'true')}) AS INTEGER)), 'now': {each(now)}, 'run': {each(runs)}, 'past': {each('greatest(acc.now[j] - 3, acc.past[j] - 1, -1048576)')}}}, {{'c': '', 'place': 0, 'best': CAST(-1048576 AS INTEGER), 'now': {none}, 'run': {zero}, 'past': {none}}}).best AS score FROM l)
SELECT id, name, score FROM f JOIN node n ON n.serialized_name = f.name WHERE score > 0 AND n.kind IN ('METHOD', 'STRUCT', 'CLASS', 'FILE')
ORDER BY lower(name) = '{query}' DESC, lower({_TERM.format('name')}) = '{query}' DESC, lower({_LEAD.format('name')}) = '{query}' DESC, score DESC, name, id LIMIT {limit}"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(k.task_class(F.concat(F.lit("please "), F.coalesce("text", F.lit("")), F.when(F.col("turn") % 4 == 0, " fix the bug").when(F.col("turn") % 4 == 1, " trace the route").when(F.col("turn") % 4 == 2, " who calls it").otherwise(""))).alias("task")).agg(F.count(F.lit(1)).alias("n"))


def _citations(g: Graph) -> DataFrame:
    f = g.file.select(F.col("id").alias("file_id"), "path")
    n = g.node.where("kind in ('MODULE', 'STRUCT', 'FIELD')").join(f, "file_id")
    return n.select("id", display_name().alias("name"), "path", "kind", (F.col("id") % 10 / 10).alias("score"), (F.col("id") % 2 == 0).alias("indexed"), (F.col("id") % 3 == 0).alias("resolvable"))


def _capped(g: Graph) -> DataFrame:
    c = _citations(g).select("id", "path", k.citation_score().alias("score"), (F.col("id") % 50 == 0).alias("protected"))
    return k.capped(c, 12, 3)


def _budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return k.within_bytes(d, 20_000).select("ord", "bytes")


def _roles(g: Graph) -> DataFrame:
    c = g.node.where("kind = 'STRUCT'").join(g.file.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", F.when(F.col("id") % 4 == 0, F.upper("path")).when(F.col("id") % 4 == 1, F.concat(F.lit("tests/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("id") % 5 == 0, "docs").alias("role"))
    return k.with_roles(c, g.file.select("path", F.when(F.col("id") % 2 == 0, "vendor").otherwise(file_role()).alias("role")))


def _core(g: Graph) -> DataFrame:
    c = g.node.where("kind in ('STRUCT', 'MODULE')").select(F.col("id").alias("node_id"), F.when(F.col("id") % 2 == 0, F.col("kind")).alias("kind"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("a::tests::"), "serialized_name")).alias("name"), F.when(F.col("id") % 4 == 0, 7).cast("long").alias("line"), F.lit("source").alias("role"))
    return k.with_core(c, g.node)


def _routes(g: Graph) -> DataFrame:
    c = g.edge.where("kind = 'CALL'").select((F.col("id") % 40).alias("route"), F.col("target").alias("handler"), "confidence", "certainty", F.col("target_name").alias("name"))
    return k.route_handlers(c.select("route").distinct(), c)


def _siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    headers = p.where("p_partkey % 2 = 0").select(key.alias("id"), F.col("p_brand").alias("name"), F.concat(F.lit("lib/m"), (key % 60).cast("string"), F.lit(".h")).alias("path"))
    texts = p.select(F.concat(F.lit("lib/m"), (key % 90).cast("string"), F.when(key % 3 == 0, ".cpp").when(key % 3 == 1, ".c").otherwise(".h")).alias("path"), F.concat(F.lit("impl "), "p_brand", F.lit("()")).alias("text")).distinct()
    return k.siblings_with_name(headers, texts).distinct()


def _near(g: Graph) -> DataFrame:
    return k.nearest_names(g.node.where("kind in ('METHOD', 'STRUCT')").select("id", F.col("serialized_name").alias("name")), "order_77", 30, 1)


def _hybrid(g: Graph) -> DataFrame:
    n = g.node.where("kind = 'STRUCT'")
    i = F.col("id")
    return k.weighted_hybrid(n.select("id", F.col("serialized_name").alias("name"), (i % 11).cast("double").alias("lexical"), F.when(i % 5 > 0, (i % 5) / 5).alias("semantic"), F.when(i % 3 < 2, i % 3).alias("near")), negative=("000000007",))


def _suggest(g: Graph) -> DataFrame:
    i = F.col("id")
    h = g.node.where("kind = 'NAMESPACE'").select("id", F.lit(0.0).alias("lexical"), F.lit(0.2).alias("graph"), (i % 10 / 10).alias("semantic"))
    some = k.did_you_mean(h).withColumn("case", F.lit("unmatched"))
    return some.unionByName(k.did_you_mean(h.withColumn("lexical", F.when(i % 10 == 3, 0.5).otherwise(0.0))).withColumn("case", F.lit("matched")))


def _generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph flushed and promoted, then without one file; what is live after going back."""
    p = Publisher(spark, f"{shared_dir(spark)}/loomgraph/generations-{uuid.uuid4().hex}")
    g = load_graph(spark, sf_dir)
    p.promote(flush(p, g))
    p.promote(p.stage({"node": p.table("node").where("kind <> 'FIELD'")}, base=p.live()))
    now = p.table("node").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("new"))
    now = spark.createDataFrame(now.collect(), now.schema)
    p.roll_back()
    return now.unionByName(p.table("node").groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("old")))


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's families published, then more errors appended to one of them: what the live manifest holds."""
    p = Publisher(spark, f"{shared_dir(spark)}/loomgraph/generations-{uuid.uuid4().hex}")
    g = load_graph(spark, sf_dir)
    p.promote(flush(p, g))
    p.promote(p.stage({}, {"error": g.error.where("fatal")}, p.live()), deep=True)
    return p.inventory(p.live())


_SQ = "lower(regexp_replace({0}, '[\\s_\\-]+', '', 'g'))"
_TERM = "regexp_extract({0}, '([^:.#/]*)$', 1)"
_LEAD = "regexp_extract({0}, '^([^:.#/]*)', 1)"
_HITS = "hits AS (SELECT n.id, serialized_name AS name, path, kind, start_line AS line FROM node n JOIN file f ON f.id = n.file_id WHERE kind IN ('METHOD', 'CLASS', 'STRUCT'))"


def _exact(q: str) -> tuple[str, str, str]:
    return tuple(f"CASE WHEN {_SQ.format(x.format('name') if '{0}' in x else x)} = '{q}' THEN 1 ELSE 0 END" for x in ("name", _TERM, _LEAD))  # type: ignore[return-value]


_D, _T, _L = _exact("order77")
_OTHER = f"coalesce({ROLE} IN ('test','benchmark','generated','vendor','docs'), false)"
_KIND = "CASE WHEN kind IN ('CLASS','STRUCT') THEN 4 WHEN kind = 'METHOD' THEN 3 WHEN kind IN ('MODULE','NAMESPACE') THEN 2 WHEN kind = 'FILE' THEN 0 ELSE 1 END"
_HELPER = "len(list_intersect(regexp_split_to_array(lower(concat_ws(' ', name, path)), '[^a-z0-9]+'), ['helper','helpers','mock','mocks','fake','fixture','fixtures'])) > 0"
_SEARCH = f"""WITH GRAPH, {ROOTS_SQL}, {_HITS}, h0 AS (SELECT hits.*, coalesce(r.entry, 0) AS entry, coalesce(r.place, 3) AS place, coalesce(cd.callers, 0) AS callers, coalesce(cd.callees, 0) AS callees FROM hits LEFT JOIN (SELECT id, entry, place FROM roots) r USING (id) LEFT JOIN cd USING (id) WHERE hits.kind = 'METHOD'), h AS (SELECT *, {_D} AS d, {_T} AS t, {_L} AS l FROM h0),
x AS (SELECT *, d + t + l > 0 AS exact, {_OTHER} AS other FROM h),
o AS (SELECT id, name, row_number() OVER (ORDER BY CAST(lower(name) = 'order_77' AS INT) DESC, CASE WHEN exact THEN 2 ELSE 0 END DESC, d DESC, t DESC, l DESC, CAST(exact OR NOT other AS INT) DESC, entry DESC, CAST(NOT ({_HELPER}) AS INT) DESC, CASE WHEN other THEN 0 ELSE {TIER.format('callers')} END DESC, {TIER.format('callees')} DESC, greatest(3 - place, 0) DESC, CASE WHEN exact THEN 0 ELSE CAST(contains(lower(name), 'order_77') AS INT) END DESC, CASE WHEN exact THEN 0 ELSE CAST(contains(lower(path), 'order_77') AS INT) END DESC, {_KIND} DESC, id) AS position FROM x)
SELECT id, name, CAST(position AS INTEGER) AS position FROM o WHERE position <= 40"""


def _resolve_sql(q: str, squeezed: str, asked: str = "") -> str:
    d, t, e = _exact(squeezed)
    return f"""c AS (SELECT * FROM hits WHERE contains({_SQ.format('name')}, '{asked or squeezed}') ORDER BY length(name), name, id LIMIT 50),
x AS (SELECT *, {d} AS d, {t} AS t, {e} AS l FROM c),
y AS (SELECT id, name, path, row(CASE WHEN d + t + l > 0 THEN 1 ELSE 0 END, d, t, l, CAST(name = '{q}' OR {_TERM.format('name')} = '{q}' AS INT), CAST({ROLE} IN ('source','entrypoint') AS INT), CAST(d + t + l = 0 AND starts_with({_SQ.format('name')}, '{squeezed}') AS INT), CAST(NOT regexp_matches(path, '\\.(d\\.ts|h|hpp|pyi)$') AS INT), {_KIND}) AS rank FROM x),
z AS (SELECT *, max(rank) OVER () AS top FROM y),
b AS (SELECT *, count(*) OVER () AS tied, row_number() OVER (ORDER BY path, name, id) AS position FROM z WHERE rank = top)
SELECT CASE WHEN tied > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, id, name, path, CAST(position AS INTEGER) AS position FROM b WHERE position <= 10"""


_TERMS = ["attion", "thing", "thble", "ering"]
_COUNT = lambda text: "(" + " + ".join(f"CAST(contains({text}, '{t}') AS INT)" for t in _TERMS) + ")"
_TEXT = f"""WITH t AS (SELECT coalesce(lang, 'x') || '/d' || doc_id AS path, lower(coalesce(text, '')) AS low, doc_id AS seq FROM documents),
f AS (SELECT *, {' + '.join(f"CAST(contains(low, '{t}') OR contains(lower(path), '{t}') AS INT)" for t in _TERMS)} AS either, {_COUNT('lower(path)')} AS pn FROM t),
e AS (SELECT path, low, seq, pn, unnest(string_split(low, chr(10))) AS line, generate_subscripts(string_split(low, chr(10)), 1) AS i FROM f WHERE contains(low, 'attion thing') OR either >= CASE WHEN pn > 0 THEN 2 ELSE 3 END),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CAST(contains(line, 'attion thing') AS INT) DESC, {_COUNT('line')} DESC, i) = 1),
s AS (SELECT path, i AS line, 100e0 + CASE WHEN contains(line, 'attion thing') THEN 220 WHEN contains(low, 'attion thing') THEN 140 ELSE 0 END + pn * 35 + {_COUNT('line')} * 28 + {_COUNT('low')} * 6 AS score, row_number() OVER (ORDER BY seq) AS position FROM b QUALIFY position <= 60)
SELECT path, CAST(line AS INTEGER) AS line, round(score - (position - 1) * 0.01e0, 6) AS score, CAST(position AS INTEGER) AS position FROM s"""
_TASK = "CASE WHEN regexp_matches(q, 'bug|error|failing|failed|broken|crash') THEN 'bug_localization' WHEN regexp_matches(q, 'impact|affected|regression|blast radius') THEN 'change_impact' WHEN regexp_matches(q, 'route|endpoint|handler|api path') THEN 'route_tracing' WHEN regexp_matches(q, 'owner|owns|who calls|references') THEN 'symbol_ownership' WHEN regexp_matches(q, 'data flow|flow from|flow into|flows from|flows into|pipeline|through') THEN 'data_flow' WHEN regexp_matches(q, 'where to edit|edit|change|modify|implement|add ') THEN 'edit_planning' ELSE 'architecture_explanation' END"
_CITED = f"""ci AS (SELECT n.id, qualified_name AS name, path, kind, n.id % 10 / 10e0 AS score, n.id % 2 = 0 AS indexed, n.id % 3 = 0 AS resolvable FROM node n JOIN file f ON f.id = n.file_id WHERE kind IN ('MODULE', 'STRUCT', 'FIELD')),
cs AS (SELECT id, path, round(score + CASE WHEN indexed THEN 1 ELSE 0 END + CASE WHEN resolvable THEN 0.5e0 ELSE 0 END + CASE WHEN contains(lower(name), '::') THEN 0.25e0 ELSE 0 END - CASE WHEN {ROLE} IN ('test','benchmark','generated','vendor') THEN 100 ELSE 0 END - CASE WHEN regexp_matches(path, '\\.d\\.(ts|cts|mts|tsx)$') THEN 3 ELSE 0 END - CASE WHEN regexp_matches(path, '^(extensions|vendor|deps)/|/deps/') THEN 20 ELSE 0 END - CASE WHEN {TEST_PATH.format('path')} OR {BENCH_PATH.format('path')} THEN 18 + CASE WHEN kind = 'MODULE' THEN 20 ELSE 0 END ELSE 0 END, 6) AS score FROM ci)"""
_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(p_name, '')), '[^a-z0-9]+'), lambda w: w <> '')"

ALL = {
    "search_hit_rank": (_g(_search), _SEARCH),
    "resolution_rank_ambiguous": (_g(lambda g: k.resolve_target("len", _hits(g))), f"WITH GRAPH, {_HITS}, {_resolve_sql('len', 'len')}"),
    "resolution_rank_unique": (_g(lambda g: k.resolve_target("shop::Supplier#000000003", _hits(g), "n")), f"WITH GRAPH, hits0 AS (SELECT 1), {_HITS.replace('hits AS', 'hits1 AS')}, hits AS (SELECT * FROM hits1 WHERE contains(path, 'n')), {_resolve_sql('shop::Supplier#000000003', 'shop::supplier#000000003', 'supplier#000000003')}"),
    "browse_rank": (_g(lambda g: k.browse_rank("run", _hits(g))), f"WITH GRAPH, {_HITS}, x AS (SELECT id, name, kind, {_exact('run')[0]} AS d, {_exact('run')[1]} AS t, {_exact('run')[2]} AS l FROM hits) SELECT id, name, CAST(row_number() OVER (ORDER BY d DESC, t DESC, {_KIND} DESC, l DESC, id) AS INTEGER) AS position FROM x QUALIFY position <= 50"),
    "merged_by_node": (_g(_merged), "WITH GRAPH, n AS (SELECT id FROM node WHERE kind = 'STRUCT'), a AS (SELECT id, id % 13 / 13e0 AS score, 0 AS late, row_number() OVER (ORDER BY id) AS p FROM n WHERE id % 3 <> 0), b AS (SELECT id, id % 7 / 7e0 AS score, 1 AS late, row_number() OVER (ORDER BY id) AS p FROM n WHERE id % 2 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b), m AS (SELECT id, min(late * 1000000 + p) AS f, max(score) AS score, arg_max(late, score * 2 - late * 1e-9) AS late FROM u GROUP BY id) SELECT id, score, late = 1 AS replaced, CAST(row_number() OVER (ORDER BY f, id) AS INTEGER) AS position FROM m"),
    "unique_inexact_hits": (_g(_inexact), f"WITH GRAPH, h AS (SELECT n.id, serialized_name AS name, kind, path FROM node n JOIN file f ON f.id = n.file_id WHERE kind IN ('METHOD', 'FIELD')) SELECT * FROM h QUALIFY {' + '.join(_exact('len'))} > 0 OR row_number() OVER (PARTITION BY name, kind, path ORDER BY id) = 1"),
    "did_you_mean": (_g(_suggest), "WITH GRAPH, h AS (SELECT id, 0e0 AS lexical, 0.2e0 AS graph, id % 10 / 10e0 AS semantic FROM node WHERE kind = 'NAMESPACE') SELECT *, 'unmatched' AS \"case\" FROM h WHERE semantic >= 0.18 ORDER BY semantic DESC, id LIMIT 5"),
    "repo_text": (_texts, _TEXT),
    "task_classes": (_tasks, f"WITH c AS (SELECT lower('please ' || coalesce(text, '') || CASE turn % 4 WHEN 0 THEN ' fix the bug' WHEN 1 THEN ' trace the route' WHEN 2 THEN ' who calls it' ELSE '' END) AS q FROM conversations) SELECT {_TASK} AS task, count(*) AS n FROM c GROUP BY 1"),
    "citation_scores": (_g(lambda g: _citations(g).select("id", k.citation_score().alias("score"))), f"WITH GRAPH, {_CITED} SELECT id, score FROM cs"),
    "citation_cap": (_g(_capped), f"WITH GRAPH, {_CITED}, c AS (SELECT *, id % 50 = 0 AS protected FROM cs), fb AS (SELECT path FROM (SELECT path, max(score) AS s, arg_min(id, (-score, id)) AS i FROM c WHERE NOT protected GROUP BY path) ORDER BY s DESC, i, path LIMIT 3), r AS (SELECT * FROM c WHERE NOT protected AND path IN (SELECT path FROM fb) ORDER BY score DESC, id LIMIT 12) SELECT * FROM c WHERE protected UNION ALL SELECT * FROM r"),
    "byte_budget": (_budget, "SELECT doc_id AS ord, CAST(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id) AS BIGINT) AS bytes FROM documents WHERE text <> '' QUALIFY bytes <= 20000"),
    "role_enrichment": (_g(_roles), f"WITH GRAPH, c AS (SELECT n.id, CASE n.id % 4 WHEN 0 THEN upper(path) WHEN 1 THEN 'tests/' || path ELSE path END AS path, CASE WHEN n.id % 5 = 0 THEN 'docs' END AS role FROM node n JOIN file f ON f.id = n.file_id WHERE kind = 'STRUCT'), s AS (SELECT path AS p, CASE WHEN id % 2 = 0 THEN 'vendor' ELSE {ROLE} END AS stored FROM file) SELECT id, path, coalesce(role, stored, {ROLE}) AS role FROM c LEFT JOIN s ON p = lower(path)"),
    "core_enrichment": (_g(_core), "WITH GRAPH SELECT id AS node_id, kind, CASE WHEN id % 3 = 0 THEN 'a::tests::' || serialized_name ELSE qualified_name END AS name, CASE WHEN id % 4 = 0 THEN 7 ELSE start_line END AS line, CASE WHEN id % 3 = 0 THEN 'test' ELSE 'source' END AS role FROM node WHERE kind IN ('STRUCT', 'MODULE')"),
    "route_handlers": (_g(_routes), f"WITH GRAPH, c AS (SELECT id % 40 AS route, target AS handler, confidence, coalesce(certainty, {BAND}) AS sure, target_name AS name FROM edge WHERE kind = 'CALL') SELECT route, handler FROM c QUALIFY row_number() OVER (PARTITION BY route ORDER BY confidence DESC NULLS LAST, CASE sure WHEN 'certain' THEN 0 WHEN 'probable' THEN 1 WHEN 'uncertain' THEN 2 ELSE 3 END, name, handler) = 1"),
    "evidence_siblings": (_siblings, "WITH h AS (SELECT p_partkey AS id, p_brand AS name, p_partkey % 60 AS stem FROM part WHERE p_partkey % 2 = 0), t AS (SELECT DISTINCT p_partkey % 90 AS stem, 'lib/m' || (p_partkey % 90) || CASE p_partkey % 3 WHEN 0 THEN '.cpp' ELSE '.c' END AS path, 'impl ' || p_brand || '()' AS text FROM part WHERE p_partkey % 3 < 2) SELECT DISTINCT id, path FROM h JOIN t USING (stem) WHERE contains(text, name)"),
    "candidate_mass": (_g(lambda g: k.candidate_mass(_citations(g))), "WITH GRAPH SELECT round(sum(n.id % 10 / 10e0), 6) AS mass FROM node n JOIN file f ON f.id = n.file_id WHERE kind IN ('MODULE', 'STRUCT', 'FIELD')"),
    "fuzzy_symbols": (lambda s, d: gr.fuzzy_symbols(name_index(s, d), "od17", 60), _fuzzy_sql("od17", 60)),
    "fuzzy_paths": (lambda s, d: gr.fuzzy_symbols(name_index(s, d), "srcrs", 200), _fuzzy_sql("srcrs", 200)),
    "nearest_names": (_g(_near), "WITH GRAPH, n AS (SELECT id, serialized_name AS name, levenshtein(lower(regexp_extract(serialized_name, '([^:.#/]*)$', 1)), 'order_77') AS distance FROM node WHERE kind IN ('METHOD', 'STRUCT')) SELECT id, name, CAST(distance AS INTEGER) AS distance FROM n WHERE distance <= 1 ORDER BY distance, name, id LIMIT 30"),
    "hash_projection": (lambda s, d: table(s, d, "part").select("p_partkey", F.posexplode(k.projected(F.col("p_name"), 8)).alias("dim", "x")).where("x <> 0"), f"WITH w AS (SELECT p_partkey, unnest({_WORDS}) AS w FROM part), h AS (SELECT p_partkey, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS h FROM w), v AS (SELECT p_partkey, h % 8 AS dim, sum(CASE WHEN (h >> 32) % 2 = 0 THEN 1e0 ELSE -1e0 END) AS x FROM h GROUP BY ALL), n AS (SELECT p_partkey, sqrt(sum(x * x)) AS n FROM v GROUP BY 1) SELECT p_partkey, CAST(dim AS INTEGER) AS dim, round(x / n, 6) AS x FROM v JOIN n USING (p_partkey) WHERE x <> 0"),
    "weighted_hybrid": (_g(_hybrid), "WITH GRAPH, n AS (SELECT id, serialized_name AS name, CAST(id % 11 AS DOUBLE) AS l, CASE WHEN id % 5 > 0 THEN id % 5 / 5e0 ELSE 0e0 END AS s, CASE id % 3 WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.55e0 ELSE 0e0 END AS b FROM node WHERE kind = 'STRUCT') SELECT id, round((0.5e0 * (l / (SELECT max(l) FROM n)) + 0.35e0 * s + 0.15e0 * b) * CASE WHEN contains(lower(name), '000000007') THEN 0.72e0 ELSE 1e0 END, 6) AS score FROM n"),
    "published_families": (_families, """WITH GRAPH SELECT 'file' AS family, CAST(1 AS BIGINT) AS parts, (SELECT count(*) FROM file) AS rows UNION ALL SELECT 'node', 1, (SELECT count(*) FROM node) UNION ALL SELECT 'edge', 1, (SELECT count(*) FROM edge) UNION ALL SELECT 'occurrence', 1, (SELECT count(*) FROM occurrence)
UNION ALL SELECT 'component_access', 1, (SELECT count(*) FROM edge WHERE kind = 'MEMBER' AND target IN (SELECT id FROM node)) UNION ALL SELECT 'callable_state', 1, (SELECT count(*) FROM node WHERE kind IN ('FUNCTION', 'METHOD', 'MACRO') AND file_id IN (SELECT id FROM file)) UNION ALL SELECT 'text_unit', 1, (SELECT count(*) FROM node WHERE kind <> 'FILE')
UNION ALL SELECT 'exclusion', 1, (SELECT count(*) FROM file WHERE size > 1048576) UNION ALL SELECT 'kind_count', 1, (SELECT count(DISTINCT kind) FROM node) UNION ALL SELECT 'error', 2, (SELECT count(*) + count(*) FILTER (WHERE fatal) FROM error)"""),
    "published_generations": (_generation, "WITH GRAPH SELECT kind, count(*) AS n, 'old' AS state FROM node GROUP BY kind UNION ALL SELECT kind, count(*), 'new' FROM node WHERE kind <> 'FIELD' GROUP BY kind"),
}
