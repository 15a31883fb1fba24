"""Calls of the service that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import service as v
from loomgraph.plans.fragments import BENCH_PATH, COMMON, EFFECTIVE, IN, ROLE, TEST_PATH
from loomgraph.plans.queries_search import QUERY, _vectors, lexical_index
from loomgraph.sources.star_schema import BASE, load_graph, table

NODE, CENTRE = 5 * BASE + 9, 3 * BASE + 10


def service(spark: SparkSession, sf_dir: str) -> v.Service:
    """The service over a folder of tables; the lexical index is built by the first call that searches."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return v.Service(load_graph(spark, sf_dir), lambda: lexical_index(spark, sf_dir), _vectors(spark, sf_dir), texts)


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = service(spark, sf_dir).search(f"{QUERY} kind:struct", 5)
    return spark.createDataFrame([(r["node_id"], r["kind"], r["quality"]) for r in rows], "node_id long, kind string, quality string")


_QUIET = f"qt AS (SELECT * FROM eff WHERE NOT (kind = 'CALL' AND target_name IN ({COMMON})) AND NOT coalesce({TEST_PATH.format('caller_path')} OR {BENCH_PATH.format('caller_path')}, false))"

ALL = {
    "service_callees": (lambda s, d: service(s, d).callees(CENTRE).nodes.select("id", "depth"), f"WITH GRAPH, {EFFECTIVE}, {_QUIET} SELECT {CENTRE} AS id, 0 AS depth UNION ALL SELECT DISTINCT dst, 1 FROM qt WHERE kind = 'CALL' AND src = {CENTRE} AND dst IN (SELECT id FROM node)"),
    "service_callers": (lambda s, d: service(s, d).callers(NODE).edges.select("src", "dst", "kind"), f"WITH GRAPH, {EFFECTIVE}, {_QUIET} SELECT DISTINCT src, dst, kind FROM qt WHERE kind = 'CALL' AND dst = {NODE}"),
    "service_references": (lambda s, d: service(s, d).references(6 * BASE + 7, 5), f"WITH GRAPH, {EFFECTIVE}, r AS (SELECT id, kind, src FROM eff WHERE dst = {6 * BASE + 7} AND src <> dst), f AS (SELECT src FROM r GROUP BY src ORDER BY min(id) LIMIT 5) SELECT * FROM r WHERE src IN (FROM f)"),
    "service_neighborhood": (lambda s, d: service(s, d).neighborhood(NODE), f"WITH GRAPH, {EFFECTIVE}, o AS (SELECT src FROM eff WHERE kind = 'MEMBER' AND dst = {NODE}) SELECT id, kind, src, dst FROM eff WHERE src = {NODE} OR dst = {NODE} OR (kind IN ('INHERITANCE', 'OVERRIDE') AND (src IN (FROM o) OR dst IN (FROM o))) ORDER BY id LIMIT 400"),
    "service_symbols": (lambda s, d: service(s, d).symbols("src/main.rs", 30), "WITH GRAPH SELECT n.id, serialized_name AS name, kind, start_line AS line FROM node n JOIN file f ON f.id = n.file_id WHERE path = 'src/main.rs' AND kind <> 'FILE' ORDER BY line, name, n.id LIMIT 30"),
    "service_definition": (lambda s, d: service(s, d).definition("Supplier#000000003"), "WITH GRAPH SELECT n.id, kind, qualified_name AS name, path, start_line, end_line FROM node n LEFT JOIN file f ON f.id = n.file_id WHERE serialized_name = 'Supplier#000000003'"),
    "service_affected": (lambda s, d: service(s, d).affected(s.createDataFrame([("SRC\\main.rs",)], "path string"), 1, "main"), f"WITH GRAPH, {EFFECTIVE}, l0 AS (SELECT n.id, 0 AS depth FROM node n JOIN file f ON f.id = n.file_id WHERE path = 'src/main.rs'), l1 AS (SELECT DISTINCT b AS id, 1 AS depth FROM l0 JOIN ({IN}) x ON a = l0.id WHERE b NOT IN (SELECT id FROM l0)), u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1) SELECT n.id, qualified_name AS name, path, depth AS distance FROM u JOIN node n USING (id) LEFT JOIN file f ON f.id = n.file_id WHERE kind <> 'FILE' AND (contains(lower(qualified_name), 'main') OR contains(lower(path), 'main')) ORDER BY distance, path NULLS FIRST, name, CAST(n.id AS VARCHAR) LIMIT 200"),
    "service_search": (_answers, None),
    "test_map": (lambda s, d: v.test_map(load_graph(s, d)), f"WITH GRAPH, {EFFECTIVE}, loc AS (SELECT n.id, path FROM node n JOIN file f ON f.id = n.file_id) SELECT b.path, count(DISTINCT a.path) AS tests FROM eff JOIN loc a ON a.id = src JOIN loc b ON b.id = dst WHERE ({TEST_PATH.format('a.path')} OR {BENCH_PATH.format('a.path')}) AND {ROLE.replace('path', 'b.path')} IN ('source', 'entrypoint') GROUP BY b.path"),
}
