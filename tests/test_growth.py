"""Work of one task that must not grow with the tables: what is sorted or joined is dealt by rows."""

import re

from pyspark.sql import functions as F

from loomgraph.operators import adjacency, grams, ranks, resolution, search
from loomgraph.plans import queries_ranks, queries_service
from loomgraph.sources import star_schema, store
from loomgraph.sources.star_schema import Graph, load_graph

SF = "/root/testdata/sf0.001"


def rows_of_files(df):
    return sorted(r["count"] for r in df.groupBy(F.input_file_name()).count().collect())


def test_the_stored_graph_is_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 500)
    g = star_schema._build(spark, SF)
    for df in (g.node, g.edge, g.occurrence):
        sizes = rows_of_files(df)
        assert max(sizes) <= 1000 and sum(sizes) == df.count()
    stored = load_graph(spark, SF)
    for name in ("node", "edge", "occurrence"):
        a, b = getattr(g, name), getattr(stored, name)
        assert sorted(a.columns) == sorted(b.columns) and a.select(*b.columns).exceptAll(b).isEmpty() and a.count() == b.count()


def test_the_adjacency_stores_no_names_and_reads_the_edges_ends(spark):
    own = adjacency.adjacency_of(load_graph(spark, SF).edge)
    for side, (a, b) in ((own.outgoing, ("at", "next")), (own.incoming, ("next", "at"))):
        assert not {"target_name", "caller_path"} & set(side.rows.columns)
        assert side.rows.where(~F.col("src").eqNullSafe(F.col(a)) | ~F.col("dst").eqNullSafe(F.col(b))).isEmpty()


def test_a_common_term_is_several_tasks_work(spark):
    texts = spark.range(2000).select(F.col("id").alias("key"), F.lit("p").alias("path"), F.lit("same words").alias("content"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("line"), F.lit(0).alias("source"))
    postings = store.stored(search.build_index(texts, 12).postings)
    same = rows_of_files(postings.where("term = 'same'"))
    assert sum(same) == 2000 and len(same) > 1 and max(same) < 1500


def test_calls_that_do_not_search_build_no_index(spark, monkeypatch):
    monkeypatch.setattr(queries_service, "lexical_index", lambda *a: 1 / 0)
    assert queries_service.ALL["service_definition"][0](spark, SF).count() <= 1
    assert not queries_service.ALL["service_callees"][0](spark, SF).isEmpty()


def test_edges_without_a_resolution_are_dealt_in_a_deletion(spark):
    shape = "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string, file_id long, target_name string, caller_path string"
    edges = spark.createDataFrame([(i, "CALL", 1, 2, None, [None, 1, 3][i % 3] if i % 10 == 0 else None, None, None, 1, "f", "a") for i in range(400)], shape)
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, file_id long")
    g = Graph(nodes, edges, spark.createDataFrame([], "element_id long, file_id long"), spark.createDataFrame([(1,), (2,)], "id long"))
    left = resolution.delete_files(g, spark.createDataFrame([(2,)], "file_id long")).edge
    got = {r.id: r.resolved_target for r in left.collect()}
    assert got == {i: 1 if i % 10 == 0 and i % 3 == 1 else None for i in range(400)}
    assert re.search(r"hashpartitioning\(resolved_target#\d+L?, unresolved#\d+L?, \d+\), REPARTITION_BY_NUM", left._jdf.queryExecution().executedPlan().toString())


def test_hits_are_dealt_by_what_makes_them_equal(spark, monkeypatch):
    monkeypatch.setattr(store, "TASK_ROWS", 100)
    hits = queries_ranks.ALL["unique_inexact_hits"][0](spark, SF)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    n = load_graph(spark, SF).node.where("kind in ('METHOD', 'FIELD')").count()
    assert "SinglePartition" not in plan and f", {-(-n // 100)}), REPARTITION_BY_NUM" in plan
    # Exact hits of one name and file are several tasks' work, and all of them stay.
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, "len").otherwise("run").alias("name"), F.lit("METHOD").alias("kind"), F.lit("a.rs").alias("path"), F.col("id").alias("position"))
    out = ranks.unique_inexact("len", rows.unionByName(rows.where("id = 5")), 3000)
    assert sorted(r.id for r in out.collect()) == sorted([*range(2000), 5, 2000])
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 500


def test_names_that_differ_in_other_characters_are_scored_once(spark, monkeypatch):
    names = [f"Order_{n}" for n in range(3000)] + ["O d%1_7", "od17é", "ÖD17", "oD\\17", "7d1o"]
    index = grams.build_names(spark.createDataFrame(list(enumerate(names)), "id long, name string"))
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name

    plain = grams.subsequence_score
    for query in ("od17", "d%1", "d\\1", "17é"):
        expected = {(r.name, r.score) for r in index.names.select("name", plain(F.col("name"), query).alias("score")).where("score is not null").collect()}
        monkeypatch.setattr(grams, "subsequence_score", lambda name, q: plain(F.udf(counted, "string")(name), q))
        got = [(r.name, r.score) for r in grams.fuzzy_symbols(index, query, 5000).collect()]
        assert len(got) == len(set(got)) and set(got) == expected and expected
        monkeypatch.setattr(grams, "subsequence_score", plain)
    assert 0 < seen.value < 100
