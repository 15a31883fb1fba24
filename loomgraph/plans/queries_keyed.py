"""Tables kept by key, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators.keyed import Keyed
from loomgraph.sources.star_schema import BASE, Graph, load_graph


def _g(f):  # noqa: ANN001, ANN202
    return lambda spark, sf_dir: f(load_graph(spark, sf_dir))


def _docs(g: Graph) -> Keyed:
    """A document for each type: what it is called and how long its name is."""
    n = g.node.where("kind in ('CLASS', 'STRUCT')")
    return Keyed(n.select(F.col("id").alias("node_id"), "file_id", "kind", F.col("serialized_name").alias("doc"), F.md5(F.col("qualified_name").cast("binary")).alias("content_hash"), F.lit("v1").alias("contract")))


def _batch(g: Graph):  # noqa: ANN202
    return _docs(g).rows.where("node_id % 3 = 0").withColumns({"doc": F.concat("doc", F.lit("*")), "node_id": F.when(F.col("node_id") % 2 == 0, F.col("node_id")).otherwise(F.col("node_id") + 1_000_000)})


def _ids(g: Graph):  # noqa: ANN202
    return g.node.where("id % 5 = 1").select("id")


_DOCS = "docs AS (SELECT id AS node_id, file_id, kind, serialized_name AS doc, md5(qualified_name) AS content_hash, 'v1' AS contract FROM node WHERE kind IN ('CLASS', 'STRUCT'))"
_BATCH = "batch AS (SELECT CASE WHEN node_id % 2 = 0 THEN node_id ELSE node_id + 1000000 END AS node_id, file_id, kind, doc || '*' AS doc, content_hash, contract FROM docs WHERE node_id % 3 = 0)"
_FRAME = "strlen(CAST({0} AS VARCHAR)) || ':' || {0}"

ALL = {
    "keyed_upsert": (_g(lambda g: _docs(g).upsert(_batch(g)).rows.select("node_id", "doc")), f"WITH GRAPH, {_DOCS}, {_BATCH} SELECT node_id, doc FROM docs WHERE node_id NOT IN (SELECT node_id FROM batch) UNION ALL SELECT node_id, doc FROM batch"),
    "keyed_page": (_g(lambda g: _docs(g).after(3 * BASE + 17, 40).select("node_id", "doc")), f"WITH GRAPH, {_DOCS} SELECT node_id, doc FROM docs WHERE node_id > {3 * BASE + 17} ORDER BY node_id LIMIT 40"),
    "keyed_by_keys": (_g(lambda g: _docs(g).by_keys(_ids(g)).select("node_id", "doc")), f"WITH GRAPH, {_DOCS} SELECT node_id, doc FROM docs WHERE node_id % 5 = 1"),
    "keyed_copy": (_g(lambda g: _docs(g).copied_from(Keyed(_batch(g)), g.node.select(F.col("id") + 1_000_000)).rows.select("node_id", "doc")), f"WITH GRAPH, {_DOCS}, {_BATCH} SELECT node_id, doc FROM docs UNION ALL SELECT node_id, doc FROM batch WHERE node_id NOT IN (SELECT node_id FROM docs) AND node_id IN (SELECT id + 1000000 FROM node)"),
    "keyed_without_files": (_g(lambda g: _docs(g).without_files(g.file.where("id % 4 = 1").select("id"), _ids(g)).rows.select("node_id", "file_id")), f"WITH GRAPH, {_DOCS} SELECT node_id, file_id FROM docs WHERE node_id % 5 = 1 OR file_id NOT IN (SELECT id FROM file WHERE id % 4 = 1)"),
    "keyed_reuse": (_g(lambda g: _docs(g).current(_docs(g).rows.withColumn("content_hash", F.when(F.col("node_id") % 4 > 0, F.col("content_hash")).otherwise("old"))).select("node_id")), f"WITH GRAPH, {_DOCS} SELECT node_id FROM docs WHERE node_id % 4 > 0"),
    "keyed_stats": (_g(lambda g: _docs(g).stats("kind")), f"WITH GRAPH, {_DOCS} SELECT kind AS value, count(*) AS n, count(DISTINCT file_id) AS files FROM docs GROUP BY kind"),
    "keyed_manifest": (_g(lambda g: _docs(g).manifest("doc", "content_hash")), f"WITH GRAPH, {_DOCS}, r AS (SELECT node_id AS k, sha256({_FRAME.format('node_id')} || {_FRAME.format('doc')} || {_FRAME.format('content_hash')}) AS h FROM docs), b AS (SELECT k // 1000 AS k, count(*) AS n, sha256(string_agg(h, '' ORDER BY k)) AS h FROM r GROUP BY k // 1000) SELECT 'all' AS \"group\", CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, '' ORDER BY k)) AS digest FROM b"),
}
