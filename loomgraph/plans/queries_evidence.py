"""Evidence of one packet a class of the graph: its calls are cited, their edges prove its claims. With their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import certainty_of
from loomgraph.operators import evidence as e
from loomgraph.operators.relational import neutralised
from loomgraph.plans.fragments import BAND, EFFECTIVE
from loomgraph.sources.star_schema import BASE, Graph, load_graph
from loomgraph.sources.store import kept, stored, tasks_for


def _evidence(g: Graph) -> tuple[e.Evidence, int]:
    """The frames of all packets, and the number of calls. Calls and what they come to are written once; the frames are made of them as they are read."""
    files = g.file.select(F.col("id").alias("file_id"), "path", "complete")
    read = F.when(F.col("id") % 6 == 0, "").otherwise(F.col("qualified_name"))
    nodes = g.node.select(F.col("id").alias("node"), F.col("serialized_name").alias("name"), F.when(F.col("id") % 2 == 0, read).alias("snippet"), "start_line", "end_line", F.col("file_id"))
    own = nodes.where((F.col("node") > 3 * BASE) & (F.col("node") < 4 * BASE)).join(files, "file_id", "left").withColumn("k", F.col("node") - 3 * BASE).withColumn("packet", F.col("node"))
    k = F.col("k")
    packets = own.select(
        "packet", F.when(k % 3 == 0, F.concat(F.lit("trace `"), "name", F.lit("` in ("), "path", F.lit("), please"))).otherwise(F.concat(F.lit("explain "), "name")).alias("question"), (k % 29 != 0).alias("fresh"), (k % 37 == 0).alias("error"),
        (k % 41 != 0).alias("pinned"), (k % 4 == 0).alias("drilled"), (k % 23 == 0).alias("truncated"), F.when(k % 31 == 0, "probe-0").alias("ambiguous"),
    )
    label = F.coalesce("certainty", certainty_of())
    calls = neutralised(g.edge).where("kind in ('CALL', 'INHERITANCE')").select(F.col("src").alias("packet"), F.col("id").alias("ord"), "kind", F.col("dst").alias("node"), label.alias("label"))
    # Paths follow the nodes' other columns, so that they are not shuffled.
    calls = calls.join(nodes, "node").join(files.drop("complete"), "file_id", "left").drop("file_id").join(own.select("packet", F.col("name").alias("source")), "packet")
    calls = stored(calls, "packet")
    n_calls = calls.count()
    cites = calls.where("kind = 'CALL'")
    node_id = F.col("node").cast("string")
    citations = cites.select("packet", "ord", node_id.alias("node_id"), "name", "path", F.col("start_line").alias("line"), F.coalesce(F.col("label") != "uncertain", F.lit(True)).alias("eligible"))
    ranges = cites.where("node % 2 = 0").select("packet", F.concat(F.lit("source:"), node_id).alias("id"), node_id.alias("node_id"), "path", "start_line", "end_line", "snippet")
    edges = calls.where("label is null or label <> 'uncertain'").select("packet", "ord", F.col("ord").cast("string").alias("id"), "kind", "source", F.col("name").alias("target"))
    of_packet = cites.groupBy("packet").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "certain").alias("sure"), F.min("node").cast("string").alias("least"))
    told = stored(own.join(of_packet, "packet", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "sure": F.coalesce("sure", F.lit(0))}).drop("snippet"), "packet")
    searches = told.select("packet", F.lit(0).alias("ord"), F.col("name").alias("query"), F.when(k % 13 == 0, "cancelled").otherwise("completed").alias("completion"), F.col("n").alias("resolved"), F.col("n").alias("candidates"), (k % 26 == 0).cast("int").alias("blocking"))
    none = F.lit(None).cast("string")
    claims = told.select(
        "packet", F.lit(0).alias("ord"), F.lit("calls").alias("id"), F.lit("dispatch").alias("kind"), (k % 5 != 0).alias("material"), F.lit(False).alias("bound"), F.when(F.col("sure") > 0, "proven").otherwise("reported").alias("status"), F.lit("CALL").alias("edge_kind"),
        F.col("sure").alias("edge_proofs"), F.col("least").alias("node_id"), F.when(k % 2 == 0, F.col("path")).alias("path"), none.alias("probe_path"), F.when(k % 19 == 0, "named_sql_table_carriers_missing:x").alias("reason"),
    ).unionByName(told.select(
        "packet", F.lit(1).alias("ord"), F.lit("probe").alias("id"), F.lit("exact_probe").alias("kind"), F.lit(True).alias("material"), (k % 3 == 0).alias("bound"), F.when(k % 7 != 0, "proven").otherwise("reported").alias("status"), none.alias("edge_kind"),
        F.lit(0).cast("long").alias("edge_proofs"), none.alias("node_id"), none.alias("path"), F.col("path").alias("probe_path"), none.alias("reason"),
    ))
    coverage = own.select("packet", "path", F.when(F.col("complete"), "complete").otherwise("incomplete").alias("status"), F.when(k % 2 == 0, "parser_partial").otherwise("unreadable").alias("reason"))
    probes = own.where(k % 11 == 0).select("packet", F.lit(0).alias("ord"), "path")
    return e.Evidence(packets, citations, ranges, edges, searches, claims, coverage, probes), n_calls


def _compiled(spark, sf_dir: str) -> tuple[e.Evidence, int]:  # noqa: ANN001
    return kept(spark, f"evidence:{sf_dir}", lambda: _evidence(load_graph(spark, sf_dir)))


def _support(spark, sf_dir: str, upto: str) -> DataFrame:  # noqa: ANN001
    found, n_calls = _compiled(spark, sf_dir)
    # A call is cited, read and an edge, at most.
    return e.support_units(found, upto, tasks_for(spark, 3 * n_calls))


_LABEL = f"coalesce(certainty, {BAND})"
_BASE = f"""{EFFECTIVE},
placed AS (SELECT n.id AS node, serialized_name AS name, qualified_name AS full_name, start_line, end_line, f.path, f.complete FROM node n LEFT JOIN file f ON f.id = n.file_id),
own AS MATERIALIZED (SELECT *, node AS packet, node - 30000000000 AS k FROM placed WHERE node > 30000000000 AND node < 40000000000),
calls AS MATERIALIZED (SELECT o.packet, e.id AS ord, e.kind, e.dst AS node, {_LABEL} AS label, o.name AS source, p.name, p.full_name, p.start_line, p.end_line, p.path FROM eff e JOIN own o ON o.packet = e.src JOIN placed p ON p.node = e.dst WHERE e.kind IN ('CALL', 'INHERITANCE')),
told AS MATERIALIZED (SELECT o.*, coalesce(n, 0) AS n, coalesce(sure, 0) AS sure, least_node FROM own o LEFT JOIN (SELECT packet, count(*) AS n, count(*) FILTER (WHERE label = 'certain') AS sure, min(node) AS least_node FROM calls WHERE kind = 'CALL' GROUP BY packet) USING (packet)),
cited AS MATERIALIZED (SELECT packet, node, name, path, start_line, ord FROM calls WHERE kind = 'CALL' AND (label IS NULL OR label <> 'uncertain') QUALIFY row_number() OVER (PARTITION BY packet, node ORDER BY ord) = 1),
ranges AS MATERIALIZED (SELECT DISTINCT packet, node, path, start_line, end_line, full_name AS snippet FROM calls WHERE kind = 'CALL' AND node % 2 = 0 AND node % 6 <> 0),
unit AS MATERIALIZED (
  SELECT packet, 0 AS a, ord AS b, 0 AS c, 'symbol:' || node AS id, 'symbol_location' AS kind, CASE WHEN path IS NULL THEN name WHEN start_line IS NULL THEN name || ' at ' || path ELSE name || ' at ' || path || ':' || start_line END AS summary FROM cited
  UNION ALL SELECT packet, 0, c.ord, 1, 'source:' || node, 'source_range', 'source for ' || node || ' at ' || r.path || ':' || r.start_line || '-' || r.end_line FROM ranges r JOIN cited c USING (packet, node)
  UNION ALL SELECT packet, 1, ord, 0, 'edge:' || ord, 'typed_graph_edge', '`' || source || '` ' || kind || ' `' || name || '`' FROM calls WHERE label IS NULL OR label <> 'uncertain'
  UNION ALL SELECT packet, 2, 0, 0, 'negative:' || name, 'complete_query_negative', 'searched `' || name || '`, zero hits' FROM told WHERE n = 0 AND k % 13 <> 0),
claim AS MATERIALIZED (
  SELECT packet, 0 AS ord, 'calls' AS id, k, sure = 0 AND k % 5 <> 0 AS open, k % 19 = 0 AS schema_gap, 'dispatch' AS kind, least_node, CASE WHEN k % 2 = 0 THEN path END AS path, CAST(NULL AS VARCHAR) AS probe_path, sure FROM told
  UNION ALL SELECT packet, 1, 'probe', k, k % 7 = 0 AND k % 3 = 0, false, 'exact_probe', NULL, NULL, path, 0 FROM told),
unmet AS (SELECT * FROM claim WHERE open),
words AS (SELECT packet, i - 1 AS ord, regexp_replace(w, '^[^A-Za-z0-9/\\\\._-]+|[^A-Za-z0-9/\\\\._-]+$', '', 'g') AS w FROM (SELECT packet, unnest(s) AS w, generate_subscripts(s, 1) AS i FROM (SELECT packet, string_split_regex(CASE WHEN k % 3 = 0 THEN 'trace `' || name || '` in (' || path || '), please' ELSE 'explain ' || name END, '[\\s`"'',;()]') AS s FROM own))),
opt AS (
  SELECT packet, 1 AS a, 0 AS b, 0 AS c, 'bounded_source_read' AS option, path AS target, 'named-path:' || path AS gap FROM own WHERE k % 11 = 0
  UNION ALL SELECT packet, 2, ord, 1, 'bounded_source_read', path, 'omitted-material-path:' || id FROM unmet WHERE NOT schema_gap AND least_node IS NULL AND path IS NOT NULL
  UNION ALL SELECT packet, 2, ord, 2, 'bounded_source_read', probe_path, 'omitted-path:' || probe_path FROM unmet WHERE kind = 'exact_probe' AND path IS NULL AND probe_path IS NOT NULL
  UNION ALL SELECT packet, 3, ord, 0, 'bounded_source_read', w, 'named-path:' || w FROM words WHERE contains(w, '/') AND contains(w, '.')),
every AS (
  SELECT * FROM opt o WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE c.packet = o.packet AND c.path = o.target)
  UNION ALL SELECT packet, 0, 0, 0, 'deadline_lost_candidate', name, 'deadline-lost:' || name FROM own WHERE k % 23 = 0
  UNION ALL SELECT packet, 2, ord, 0, 'omitted_mandatory_support', CAST(least_node AS VARCHAR), 'omitted-edge:' || id FROM unmet WHERE kind = 'dispatch' AND sure = 0 AND least_node IS NOT NULL
  UNION ALL SELECT packet, 2, ord, 1, 'omitted_mandatory_support', CAST(least_node AS VARCHAR), 'omitted-material:' || id FROM unmet WHERE NOT schema_gap AND least_node IS NOT NULL),
offered AS MATERIALIZED (SELECT packet, option, target, gap, CAST(row_number() OVER (PARTITION BY packet ORDER BY a, b, c, option, target) AS INTEGER) AS place FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY packet, option, target ORDER BY a, b, c, gap) = 1) QUALIFY place <= 8)"""

ALL = {
    "evidence_support": (lambda s, d: _support(s, d, "summary"), f"WITH GRAPH, {_BASE} SELECT packet, CAST(row_number() OVER (PARTITION BY packet ORDER BY a, b, c, id) AS INTEGER) AS place, id, kind, summary FROM (SELECT * FROM unit QUALIFY row_number() OVER (PARTITION BY packet, id ORDER BY a, b, c) = 1)"),
    "evidence_options": (lambda s, d: e.drill_options(_compiled(s, d)[0]), f"WITH GRAPH, {_BASE} SELECT packet, place, option, target, gap FROM offered"),
    "evidence_dispositions": (lambda s, d: e.dispositions(_compiled(s, d)[0], _support(s, d, "kind"), e.drill_options(_compiled(s, d)[0])), f"""WITH GRAPH, {_BASE},
x AS (SELECT o.packet, k, (SELECT count(*) FROM (SELECT DISTINCT id FROM unit u WHERE u.packet = o.packet)) AS support, (SELECT count(*) FROM offered f WHERE f.packet = o.packet) AS options, (SELECT count(*) FROM unmet m WHERE m.packet = o.packet) AS unmet,
  EXISTS (SELECT 1 FROM unit u WHERE u.packet = o.packet AND kind <> 'complete_query_negative') AS positive, NOT complete AND NOT (k % 2 = 0 AND EXISTS (SELECT 1 FROM ranges r WHERE r.packet = o.packet AND r.path = o.path)) AS uncovered FROM own o),
y AS (SELECT *, CASE WHEN k % 41 = 0 THEN 0 WHEN k % 31 = 0 THEN 1 WHEN k % 29 = 0 THEN 2 WHEN uncovered THEN 3 WHEN k % 26 = 0 THEN 4 WHEN k % 37 = 0 THEN 5 WHEN k % 4 = 0 AND (unmet > 0 OR options > 0) THEN 6 WHEN k % 4 = 0 AND positive THEN 7 WHEN k % 4 = 0 THEN 8 WHEN options > 0 THEN 9 WHEN unmet > 0 THEN 10 WHEN positive THEN 7 ELSE 11 END AS r FROM x)
SELECT packet, ['unavailable', 'not_established', 'unavailable', 'unavailable', 'unavailable', 'unavailable', 'not_established', 'supported', 'not_established', 'drill_once', 'not_established', 'not_established'][r + 1] AS disposition,
  ['pinned generation is no longer current', 'a probe needs a choice', 'freshness is not established', 'source coverage is not established', 'a required search did not complete', 'retrieval failed', 'the second round left claims open', 'supported', 'the second round added no support', 'missing evidence may be closed', 'claims are unproven', 'searches found nothing'][r + 1] AS reason,
  support, options, unmet FROM y"""),
}
