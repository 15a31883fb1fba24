"""The registered queries of the graph engine, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.graph import certainty_of
from loomgraph.functions.paths import file_role
from loomgraph.operators import grounding as o
from loomgraph.operators import relational as r
from loomgraph.operators import resolution as x
from loomgraph.operators import traverse as w
from loomgraph.plans import queries_evidence, queries_inventory, queries_keyed, queries_ranks, queries_resolution, queries_search, queries_service, queries_sources, queries_walks
from loomgraph.plans.fragments import BAND, CALL_DEGREES, CERTAINTY, COMMON, DEGREES, EFFECTIVE, IN, INDEXABLE, OUT, RANK, ROLE, SNAPSHOT, TIER, bfs
from loomgraph.sources.star_schema import BASE, GRAPH_SQL, load_graph, table
from loomgraph.streaming.epochs import sealed, worklist
from loomgraph.streaming.incremental import event_rollup, refresh_plan, upsert

def _g(f):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: f(load_graph(spark, sf_dir))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("modified"), F.md5(F.encode("text", "utf-8")).alias("hash"), "doc_id")


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir)
    stored = f.where("doc_id % 10 <> 0").withColumn("modified", F.when(F.col("doc_id") % 7 == 0, F.col("modified") + 1).otherwise(F.col("modified"))).withColumn("indexed", F.col("doc_id") % 11 != 0).withColumn("retry", F.col("doc_id") % 17 == 0)
    return refresh_plan(f.where("doc_id % 13 <> 0"), stored)


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


def _unique(g) -> DataFrame:  # noqa: ANN001
    return r.global_unique(g.node.select(F.col("serialized_name").alias("name")).distinct(), g.node)


def _bands(g) -> DataFrame:  # noqa: ANN001
    return g.edge.groupBy("kind", certainty_of().alias("certainty")).agg(F.count(F.lit(1)).alias("n"))


def _changed(g) -> DataFrame:  # noqa: ANN001
    return g.node.where(F.col("id") == 4 * BASE + 5).select("id")


def _requests(g) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Unresolved usages by the name of their target, asked from their source's file; the first word of a name is its module."""
    module = F.substring_index("name", " ", 1).alias("module")
    fields = g.node.where("kind = 'FIELD'").select(F.col("id").alias("node_id"), F.col("serialized_name").alias("name"), "file_id")
    source = g.node.select(F.col("id").alias("source"), "file_id")
    e = g.edge.where("kind = 'USAGE' and resolved_target is null").select("id", "source", "target").join(fields.select(F.col("node_id").alias("target"), "name"), "target").join(source, "source")
    return e.select(F.col("id").alias("edge_id"), "name", "file_id", module), fields.select("node_id", "name", "file_id", module)


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes: an epoch every 200 numbers, a few of which are missing, lost, or of folders that do not count."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    path = F.concat(F.when(n % 41 == 0, "target/").otherwise("src/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    kind = F.when(n % 1501 == 0, "lost").when(n % 7 == 0, "membership").otherwise("mutated")
    return e.where("event_id % 997 <> 3").select(F.floor(n / 200).alias("epoch"), n.alias("seq"), path.alias("path"), kind.alias("kind"))


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _changes(spark, sf_dir)
    inventory = c.where("epoch < 3").select("path").distinct()
    return worklist(c, sealed(c, None), inventory)


_CHANGES = """c AS (SELECT event_id // 200 AS epoch, event_id AS seq, CASE WHEN event_id % 41 = 0 THEN 'target/' ELSE 'src/' END || user_id || '/' || event_type AS path, CASE WHEN event_id % 1501 = 0 THEN 'lost' WHEN event_id % 7 = 0 THEN 'membership' ELSE 'mutated' END AS kind FROM events WHERE event_id % 997 <> 3),
p AS (SELECT epoch, min(seq) AS first, max(seq) AS sealed, count(DISTINCT seq) AS n, bool_or(kind = 'lost') AS lost, count(DISTINCT path) FILTER (WHERE kind = 'mutated' AND path NOT LIKE 'target/%') AS dirty, count(DISTINCT regexp_replace(path, '/[^/]*$', '')) FILTER (WHERE kind = 'membership' AND path NOT LIKE 'target/%') AS rescan FROM c GROUP BY epoch),
s AS (SELECT epoch, coalesce(lag(sealed) OVER (ORDER BY epoch), first - 1) AS armed, sealed, CASE WHEN lost THEN 'coverage_lost' WHEN first <> coalesce(lag(sealed) OVER (ORDER BY epoch), first - 1) + 1 THEN 'missing_before' WHEN n <> sealed - first + 1 THEN 'missing_within' END AS gap, dirty, rescan FROM p)"""


def _best(g) -> DataFrame:  # noqa: ANN001
    c = g.edge.where("kind = 'TYPE_USAGE'").select(F.col("source").alias("edge_id"), F.col("target").alias("node_id"), ((F.col("target") % 97) / 100.0).alias("confidence"))
    return x.unambiguous_best(c)


def _deleted(g) -> DataFrame:  # noqa: ANN001
    left = x.delete_files(g, g.file.where("id % 4 = 1").select(F.col("id").alias("file_id")))
    return left.edge.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("resolved_target").alias("resolved"))


def _capped(g) -> DataFrame:  # noqa: ANN001
    f = g.file.select(F.col("id").alias("file_id"), "path")
    hits = g.node.where("kind = 'FIELD'").join(f, "file_id").select("id", "path", (F.col("id") % 7).alias("score"), (F.col("id") % 11 == 0).alias("exact"))
    return x.hits_per_file(hits)


_AFFECTED = f"{EFFECTIVE}, {bfs('40000000005', IN, 3)}, aff AS (SELECT n.id, coalesce(n.qualified_name, n.serialized_name) AS name, f.path, s.depth AS distance, coalesce({ROLE} IN ('test', 'benchmark'), false) AS test FROM s3 s JOIN node n USING (id) LEFT JOIN file f ON f.id = n.file_id WHERE n.kind <> 'FILE')"
#: name: (query, SQL without the graph's tables or with them if it starts with WITH GRAPH)
_ALL = {
    "report_hotspots": (_g(r.hotspots), f"WITH GRAPH, {DEGREES} SELECT * FROM deg ORDER BY total DESC, outgoing DESC, name, id LIMIT 50"),
    "report_entry_points": (_g(r.entry_points), f"WITH GRAPH, {DEGREES} SELECT * FROM deg WHERE outgoing > 0 AND (incoming = 0 OR (kind IN ('METHOD','MODULE') AND (name = 'main' OR ends_with(name, '::main') OR ends_with(name, '.main') OR contains(lower(name), 'run') OR contains(lower(name), 'start') OR contains(lower(name), 'serve') OR contains(lower(name), 'index')))) ORDER BY outgoing DESC, incoming, name, id LIMIT 50"),
    "report_bridges": (_g(r.bridges), f"WITH GRAPH, {DEGREES} SELECT *, least(incoming, outgoing) AS narrow FROM deg WHERE incoming > 0 AND outgoing > 0 ORDER BY narrow DESC, total DESC, name, id LIMIT 50"),
    "degree_map": (_g(lambda g: r.degree_map(g.edge)), f"WITH GRAPH, {EFFECTIVE} SELECT id, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming FROM (SELECT src AS id, 1 AS o FROM eff UNION ALL SELECT dst, 0 FROM eff) GROUP BY id"),
    "effective_endpoints": (_g(lambda g: r.neutralised(g.edge).select("id", "src", "dst")), f"WITH GRAPH, {EFFECTIVE} SELECT id, src, dst FROM eff"),
    "children_of_parent": (_g(lambda g: r.children(g, 2 * BASE + 3)), "WITH GRAPH SELECT n.id, n.kind, n.serialized_name FROM node n JOIN edge e ON e.target = n.id WHERE e.kind = 'MEMBER' AND e.source = 20000000003"),
    "child_presence": (_g(lambda g: r.child_presence(g, g.node)), "WITH GRAPH SELECT DISTINCT n.id FROM node n JOIN edge e ON e.source = n.id WHERE e.kind = 'MEMBER'"),
    "root_symbols": (_g(lambda g: r.root_symbols(g).select("id", "kind")), "WITH GRAPH SELECT id, kind FROM node WHERE kind <> 'FILE' AND id NOT IN (SELECT target FROM edge WHERE kind = 'MEMBER')"),
    "root_candidates": (_g(lambda g: r.root_candidates(g, 100)), f"WITH GRAPH SELECT id, kind, coalesce(qualified_name, serialized_name) AS name, start_line, {RANK} AS rank FROM node WHERE {INDEXABLE} AND id NOT IN (SELECT target FROM edge WHERE kind = 'MEMBER') ORDER BY rank, start_line, name, id LIMIT 100"),
    "member_counts": (_g(r.member_counts), "WITH GRAPH SELECT source AS id, count(*) AS members FROM edge WHERE kind = 'MEMBER' GROUP BY source"),
    "neighborhood": (_g(lambda g: r.neighborhood(g, 6 * BASE + 10)), f"WITH GRAPH, {EFFECTIVE} SELECT id, kind, src, dst FROM eff WHERE src = 60000000010 OR dst = 60000000010"),
    "direct_references": (_g(lambda g: r.direct_references(g, 6 * BASE + 7, ["USAGE"])), f"WITH GRAPH, {EFFECTIVE} SELECT id, kind, src FROM eff WHERE dst = 60000000007 AND src <> dst AND kind = 'USAGE'"),
    "edge_digest": (_g(r.edge_digest), f"WITH GRAPH, {EFFECTIVE} SELECT id, kind, count(*) AS n FROM (SELECT src AS id, kind FROM eff UNION ALL SELECT dst, kind FROM eff WHERE src <> dst) GROUP BY id, kind"),
    "edge_digest_strings": (_g(r.edge_digest_strings), f"WITH GRAPH, {EFFECTIVE}, dig AS (SELECT id, kind, count(*) AS n FROM (SELECT src AS id, kind FROM eff UNION ALL SELECT dst, kind FROM eff WHERE src <> dst) GROUP BY id, kind), ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) AS place FROM dig) SELECT id, string_agg(kind || '=' || n, ', ' ORDER BY place) AS digest FROM ranked WHERE place <= 3 GROUP BY id"),
    "nodes_by_kinds_page": (_g(lambda g: r.nodes_by_kinds(g, ["CLASS", "STRUCT"], 3 * BASE + 40, 100)), "WITH GRAPH SELECT id, kind, serialized_name FROM node WHERE kind IN ('CLASS', 'STRUCT') AND id > 30000000040 ORDER BY id LIMIT 100"),
    "edge_worklist": (_g(r.edge_worklist), "WITH GRAPH SELECT id, source, target FROM edge WHERE kind = 'CALL' AND resolved_target IS NULL AND confidence IS NULL AND certainty IS NULL"),
    "symbol_references": (_g(r.symbol_references), f"WITH GRAPH, {EFFECTIVE} SELECT dst, id, src FROM eff WHERE kind <> 'MEMBER' QUALIFY row_number() OVER (PARTITION BY dst ORDER BY id) <= 32"),
    "incoming_edge_weight": (_g(r.incoming_weight), f"WITH GRAPH, {EFFECTIVE} SELECT dst AS id, round(CAST(sum(CAST(CASE kind WHEN 'CALL' THEN 1.0 WHEN 'INHERITANCE' THEN 0.9 WHEN 'TYPE_USAGE' THEN 0.8 WHEN 'USAGE' THEN 0.75 WHEN 'IMPORT' THEN 0.6 END AS DECIMAL(10,2))) AS DOUBLE), 2) AS weight FROM eff WHERE kind <> 'MEMBER' GROUP BY dst"),
    "call_degrees": (_g(r.call_degrees), f"WITH GRAPH, {EFFECTIVE}, {CALL_DEGREES} SELECT * FROM cd"),
    "file_snapshot": (_g(r.file_snapshot), f"WITH GRAPH, {SNAPSHOT} SELECT file_id, path, role, symbol_count, best_rank FROM snap"),
    "ranked_file_summaries": (_g(r.ranked_files), f"WITH GRAPH, {SNAPSHOT} SELECT file_id, path, role, symbol_count, best_rank FROM snap ORDER BY best_rank, symbol_count DESC, path LIMIT 20"),
    "top_symbols_per_file": (_g(lambda g: r.top_symbols(g, 5)), f"WITH GRAPH SELECT * FROM (SELECT file_id, id, {RANK} AS rank, CAST(row_number() OVER (PARTITION BY file_id ORDER BY {RANK}, start_line, coalesce(qualified_name, serialized_name), id) AS INTEGER) AS row_num FROM node WHERE {INDEXABLE}) WHERE row_num <= 5"),
    "node_kind_histogram": (_g(lambda g: r.histogram(g.node, "kind", "node")), "WITH GRAPH SELECT 'node' AS what, kind AS label, count(*) AS n FROM node GROUP BY kind"),
    "edge_kind_histogram": (_g(lambda g: r.histogram(g.edge, "kind", "edge")), "WITH GRAPH SELECT 'edge' AS what, kind AS label, count(*) AS n FROM edge GROUP BY kind"),
    "language_counts": (_g(lambda g: r.histogram(g.file, "language", "file")), "WITH GRAPH SELECT 'file' AS what, language AS label, count(*) AS n FROM file GROUP BY language"),
    "file_roles": (_g(lambda g: g.file.select("id", file_role().alias("role"))), f"WITH GRAPH SELECT id, {ROLE} AS role FROM file"),
    "certainty_bands": (_g(_bands), f"WITH GRAPH SELECT kind, {BAND} AS certainty, count(*) AS n FROM edge GROUP BY ALL"),
    "coverage_buckets": (_g(lambda g: r.coverage_buckets(g, 4)), f"WITH GRAPH, {SNAPSHOT}, b AS (SELECT split_part(s.path, '/', 1) AS label, count(*) AS files, CAST(sum(symbol_count) AS BIGINT) AS symbols FROM snap s JOIN file f ON f.id = s.file_id WHERE NOT f.indexed GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY files DESC, symbols DESC, label) AS r FROM b) SELECT CASE WHEN r < 4 THEN label ELSE 'other' END AS label, CAST(sum(files) AS BIGINT) AS files, CAST(sum(symbols) AS BIGINT) AS symbols FROM k GROUP BY 1"),
    "nodes_at_file_line": (_g(lambda g: r.nodes_at_line(g, "src/core/nation_0.rs", 3)), "WITH GRAPH SELECT n.id, n.kind, n.serialized_name FROM node n JOIN occurrence o ON o.element_id = n.id JOIN file f ON f.id = o.file_id WHERE f.path = 'src/core/nation_0.rs' AND 3 BETWEEN o.line AND o.end_line"),
    "global_unique_resolution": (_g(_unique), "WITH GRAPH SELECT serialized_name AS name, min(id) AS node_id FROM node GROUP BY serialized_name HAVING count(*) = 1"),
    "trail_outgoing": (_g(lambda g: w.trail(g.edge, 1 * BASE + 1, 3)), f"WITH GRAPH, {EFFECTIVE}, {bfs('10000000001', OUT, 3)} SELECT id, depth FROM s3"),
    "reverse_impact": (_g(lambda g: w.impact(g.edge, g.node.where(F.col("id") == 4 * BASE + 5).select("id"), 3)), f"WITH GRAPH, {EFFECTIVE}, {bfs('40000000005', IN, 3)} SELECT id, depth FROM s3"),
    "store_counts": (_g(o.store_counts), "WITH GRAPH SELECT 'node' AS what, count(*) AS n FROM node UNION ALL SELECT 'edge', count(*) FROM edge UNION ALL SELECT 'file', count(*) FROM file UNION ALL SELECT 'error', count(*) FROM error UNION ALL SELECT 'fatal_error', count(*) FROM error WHERE fatal"),
    "effective_file_count": (_g(o.effective_file_count), "WITH GRAPH SELECT count(*) AS n FROM (SELECT id FROM file UNION SELECT id FROM node WHERE kind = 'FILE')"),
    "edges_for_nodes": (_g(lambda g: o.edges_for_nodes(g, g.node.where("kind = 'STRUCT'"))), "WITH GRAPH, s AS (SELECT id FROM node WHERE kind = 'STRUCT') SELECT id, kind, source, target FROM edge WHERE source IN (FROM s) OR target IN (FROM s) OR resolved_target IN (FROM s)"),
    "incoming_edges": (_g(lambda g: o.incoming_edges(g, 4 * BASE + 5)), f"WITH GRAPH, {EFFECTIVE} SELECT id, kind, src FROM eff WHERE dst = 40000000005"),
    "first_occurrence": (_g(o.first_occurrence), "WITH GRAPH SELECT element_id, arg_min(file_id, seq) AS file_id, arg_min(line, seq) AS line FROM occurrence GROUP BY element_id"),
    "top_root_symbols": (_g(lambda g: o.top_root_symbols(g, 40)), f"WITH GRAPH, t AS (SELECT file_id, id, row_number() OVER (PARTITION BY file_id ORDER BY {RANK}, start_line, coalesce(qualified_name, serialized_name), id) AS row_num FROM node WHERE {INDEXABLE}) SELECT * FROM t WHERE row_num <= 40 AND id NOT IN (SELECT target FROM edge WHERE kind = 'MEMBER')"),
    "entry_evidence": (_g(o.entry_evidence), f"WITH GRAPH, {DEGREES} SELECT n.id, CASE WHEN {ROLE} IN ('source', 'entrypoint') AND n.serialized_name = 'main' THEN 'main' WHEN {ROLE} IN ('source', 'entrypoint') AND coalesce(incoming, 0) = 0 AND outgoing >= 2 THEN 'topological_root' ELSE 'none' END AS evidence, {TIER.format('incoming')} AS in_tier, {TIER.format('outgoing')} AS out_tier FROM node n LEFT JOIN degree d USING (id) LEFT JOIN file f ON f.id = n.file_id WHERE n.kind = 'METHOD'"),
    "balanced_neighbours": (_g(o.balanced_neighbours), f"WITH GRAPH, {EFFECTIVE}, b AS (SELECT src AS id, dst AS other, kind, 'out' AS direction, id AS edge_id, {CERTAINTY} = 'certain' AS sure FROM eff WHERE src <> dst UNION ALL SELECT dst, src, kind, 'in', id, {CERTAINTY} = 'certain' FROM eff WHERE src <> dst), d AS (SELECT id, other, kind, direction, min(edge_id) AS edge_id, arg_min(kind = 'CALL' AND coalesce(sure, false), edge_id) AS c FROM b GROUP BY ALL), m AS (SELECT *, c AND row_number() OVER (PARTITION BY id, direction, c ORDER BY edge_id, other, kind) = 1 AS reserved FROM d) SELECT id, other, kind, direction, edge_id FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY CAST(reserved AS INT) DESC, edge_id, direction, other, kind) <= 8"),
    "affected_listing": (_g(lambda g: o.affected_listing(o.affected(g, _changed(g), 3), "order")), f"WITH GRAPH, {_AFFECTED} SELECT id, name, path, distance FROM aff WHERE contains(lower(name), 'order') OR contains(lower(path), 'order') ORDER BY distance, path NULLS FIRST, name, CAST(id AS VARCHAR) LIMIT 200"),
    "affected_tests": (_g(lambda g: o.affected_tests(o.affected(g, _changed(g), 3))), f"WITH GRAPH, {_AFFECTED} SELECT path, count(*) AS symbols, min(distance) AS distance FROM aff WHERE test GROUP BY path"),
    "affected_totals": (_g(lambda g: o.affected_totals(o.affected(g, _changed(g), 3))), f"WITH GRAPH, {_AFFECTED} SELECT count(*) FILTER (distance = 0) AS direct, count(*) FILTER (distance > 0) AS propagated FROM aff"),
    "canonical_fold": (_g(o.canonical_fold), f"WITH GRAPH, {EFFECTIVE} SELECT src, dst, kind, count(*) AS n, CASE min(CASE c WHEN 'certain' THEN 3 WHEN 'probable' THEN 2 WHEN 'uncertain' THEN 1 ELSE 0 END) WHEN 3 THEN 'certain' WHEN 2 THEN 'probable' WHEN 1 THEN 'uncertain' END AS certainty, min(id) AS first_id FROM (SELECT *, {CERTAINTY} AS c FROM eff) GROUP BY src, dst, kind"),
    "signed_depth_layout": (_g(lambda g: o.signed_depth(g, w.trail(g.edge, 6 * BASE + 10, 2, "both"), 6 * BASE + 10)), f"WITH GRAPH, {EFFECTIVE}, {bfs('60000000010', OUT + ' UNION ALL SELECT dst, src FROM eff', 2)}, bias AS (SELECT id, sum(b) AS bias FROM (SELECT dst AS id, 1 AS b FROM eff WHERE src = 60000000010 AND kind <> 'MEMBER' UNION ALL SELECT src, -1 FROM eff WHERE dst = 60000000010 AND kind <> 'MEMBER') GROUP BY id) SELECT id, CASE WHEN id = 60000000010 THEN 0 WHEN bias < 0 THEN -greatest(1, depth) ELSE greatest(1, depth) END AS depth FROM s2 LEFT JOIN bias USING (id)"),
    "stale_cleanup": (_g(lambda g: x.stale_cleanup(g.edge, g.node).select("id", "resolved_target", "confidence")), f"WITH GRAPH SELECT id, CASE WHEN NOT gone THEN resolved_target END AS resolved_target, CASE WHEN NOT gone THEN confidence END AS confidence FROM (SELECT *, kind = 'CALL' AND (coalesce(confidence < 0.55, false) OR (resolved_target IS NOT NULL AND lower(target_name) IN ({COMMON}) AND coalesce(certainty, {BAND}, '') <> 'certain')) AS gone FROM edge)"),
    "resolution_cascade": (_g(lambda g: x.cascade(*_requests(g))), "WITH GRAPH, c AS (SELECT id AS node_id, serialized_name AS name, file_id, split_part(serialized_name, ' ', 1) AS module FROM node WHERE kind = 'FIELD'), q AS (SELECT e.id AS edge_id, c.name, s.file_id, c.module FROM edge e JOIN c ON c.node_id = e.target JOIN node s ON s.id = e.source WHERE e.kind = 'USAGE' AND e.resolved_target IS NULL), f AS (SELECT file_id, name, min(node_id) AS n1 FROM c GROUP BY ALL), m AS (SELECT module, name, min(node_id) AS n2 FROM c GROUP BY ALL) SELECT edge_id, coalesce(n1, n2) AS node_id, CASE WHEN n1 IS NOT NULL THEN 0.95 ELSE 0.80 END AS confidence, CASE WHEN n1 IS NOT NULL THEN 'same_file' ELSE 'same_module' END AS strategy FROM q LEFT JOIN f USING (file_id, name) LEFT JOIN m USING (module, name)"),
    "unambiguous_best": (_g(_best), "WITH GRAPH, b AS (SELECT source AS edge_id, target AS node_id, (target % 97) / 100.0 AS confidence FROM edge WHERE kind = 'TYPE_USAGE'), k AS (SELECT *, max(confidence) OVER (PARTITION BY edge_id) AS top FROM b) SELECT edge_id, min(node_id) AS node_id, confidence FROM k WHERE confidence = top GROUP BY edge_id, confidence HAVING count(*) = 1"),
    "file_deletion": (_g(_deleted), "WITH GRAPH, dead AS (SELECT id FROM node WHERE file_id % 4 = 1 AND file_id IN (SELECT id FROM file)) SELECT kind, count(*) AS n, count(CASE WHEN resolved_target NOT IN (FROM dead) THEN 1 END) AS resolved FROM edge WHERE source NOT IN (FROM dead) AND target NOT IN (FROM dead) GROUP BY kind"),
    "hits_per_file": (_g(_capped), "WITH GRAPH SELECT n.id, path, n.id % 7 AS score, n.id % 11 = 0 AS exact FROM node n JOIN file f ON f.id = n.file_id WHERE n.kind = 'FIELD' QUALIFY n.id % 11 = 0 OR row_number() OVER (PARTITION BY path, n.id % 11 = 0 ORDER BY n.id % 7 DESC, n.id) <= 2"),
    "refresh_plan": (_refresh, "WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, n_chars AS m, md5(text) AS h, doc_id FROM documents), i AS (SELECT * FROM f WHERE doc_id % 13 <> 0), s AS (SELECT path, CASE WHEN doc_id % 7 = 0 THEN m + 1 ELSE m END AS m, h, doc_id % 11 <> 0 AS indexed, doc_id % 17 = 0 AS retry FROM f WHERE doc_id % 10 <> 0) SELECT path, CASE WHEN i.path IS NULL THEN 'remove' ELSE 'index' END AS action FROM i FULL JOIN s USING (path) WHERE i.path IS NULL OR s.path IS NULL OR NOT s.indexed OR s.retry OR i.m <> s.m OR i.h <> s.h"),
    "upsert_last_write": (_upsert, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id"),
    "sealed_epochs": (lambda s, d: sealed(_changes(s, d), None), f"WITH {_CHANGES} SELECT epoch, armed, sealed, gap IS NULL AS proven, gap, dirty, rescan FROM s"),
    "epoch_worklist": (_work, f"WITH {_CHANGES} SELECT DISTINCT c.epoch, path, 'rehash' AS action FROM c JOIN s ON s.epoch = c.epoch WHERE gap IS NULL AND kind = 'mutated' AND path NOT LIKE 'target/%' UNION ALL SELECT DISTINCT c.epoch, regexp_replace(path, '/[^/]*$', ''), 'rescan' FROM c JOIN s ON s.epoch = c.epoch WHERE gap IS NULL AND kind = 'membership' AND path NOT LIKE 'target/%' UNION ALL SELECT s.epoch, i.path, 'full' FROM s, (SELECT DISTINCT path FROM c WHERE epoch < 3) i WHERE gap IS NOT NULL"),
    "event_rollup": (lambda s, d: event_rollup(table(s, d, "events")), "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
}

for _part in (queries_inventory, queries_walks, queries_search, queries_resolution, queries_sources, queries_ranks, queries_service, queries_keyed, queries_evidence):
    _ALL |= _part.ALL

QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: sql.replace("WITH GRAPH", f"WITH {GRAPH_SQL}").replace("WITH RECURSIVE GRAPH", f"WITH RECURSIVE {GRAPH_SQL}") for name, (_, sql) in _ALL.items() if sql}
