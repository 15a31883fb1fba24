import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from loomgraph.functions.graph import certainty_of, node_rank
from loomgraph.operators import relational, resolution, traverse
from loomgraph.plans.queries import ORACLE_SQL, QUERIES
from loomgraph.plans.query_language import QueryError, parse
from loomgraph.sources.star_schema import Graph
from loomgraph.streaming.incremental import event_rollup, read_events, refresh_plan, upsert

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(values):
    return sorted(tuple(str(round(float(v), 6)) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    order = [expected.columns.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows([tuple(r[i] for i in order) for r in expected.fetchall()])


def edges(spark, *triples):
    shape = "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string"
    return spark.createDataFrame([(i, k, s, t, None, r, c, None) for i, (k, s, t, r, c) in enumerate(triples)], shape)


def test_trail_depths(spark):
    e = edges(spark, ("CALL", 1, 2, None, None), ("CALL", 2, 3, None, None))
    assert {r.id for r in traverse.trail(e, 1, 1).collect()} == {1, 2}
    assert {r.id for r in traverse.trail(e, 1, 2).collect()} == {1, 2, 3}
    assert {r.id: r.depth for r in traverse.trail(e, 1, 0).collect()} == {1: 0, 2: 1, 3: 2}
    assert {r.id for r in traverse.path_subgraph(e, 1, 3, 2).collect()} == {1, 2, 3}
    assert {(r.id, r.depth) for r in traverse.path_subgraph(e, 3, 1, 2).collect()} == {(3, 0), (1, None)}


def test_trail_through_a_cycle_ends(spark):
    e = edges(spark, ("CALL", 1, 2, None, None), ("CALL", 2, 1, None, None))
    assert {r.id: r.depth for r in traverse.trail(e, 1, 0).collect()} == {1: 0, 2: 1}


def test_an_unsure_call_loses_its_resolution(spark):
    e = edges(spark, ("CALL", 1, 10, 3, 0.4), ("CALL", 1, 10, 3, 0.9))
    assert [r.dst for r in relational.neutralised(e).orderBy("id").collect()] == [10, 3]


def test_certainty_and_rank(spark):
    c = spark.createDataFrame([(0.9,), (0.6,), (0.1,), (None,)], "confidence double").select(certainty_of().alias("c")).collect()
    assert [r.c for r in c] == ["certain", "probable", "uncertain", None]
    n = spark.createDataFrame([("MODULE", '"./types"'), ("CLASS", "Widget"), ("METHOD", "m"), ("MODULE", "m"), ("FIELD", "f"), ("X", "x")], "kind string, serialized_name string")
    assert [r.r for r in n.select(node_rank().alias("r")).collect()] == [5, 0, 1, 2, 3, 4]


def test_empty_graph(spark):
    shape = "id long, kind string, serialized_name string, qualified_name string, start_line long, file_id long"
    g = Graph(spark.createDataFrame([], shape), spark.createDataFrame([], "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string"), spark.createDataFrame([], "element_id long, file_id long, line long"), spark.createDataFrame([], "id long, path string, language string, indexed boolean"))
    assert relational.hotspots(g).count() == relational.root_candidates(g, 5).count() == relational.file_snapshot(g).count() == 0


def test_parse():
    ops = parse("trail('Harbour', depth: 2, direction: incoming) | filter(kind: struct) | limit(9)")
    assert [o.name for o in ops] == ["trail", "filter", "limit"] and ops[0].arguments == {"symbol": "Harbour", "depth": 2, "direction": "incoming"} and ops[2].arguments == {"n": 9}
    text = "search(query: 'quay'"
    with pytest.raises(QueryError, match="Unclosed") as e:
        parse(text)
    assert e.value.offset == len(text) and e.value.shown(text).splitlines()[1].index("^") == len(text)
    with pytest.raises(QueryError, match="Unknown `knid` argument"):
        parse("filter(knid: struct)")


def test_refresh_plan_and_upsert(spark):
    shape = "path string, modified long, hash string"
    inventory = spark.createDataFrame([("same", 1, "a"), ("newer", 2, "a"), ("rehash", 1, "b"), ("new", 1, "a")], shape)
    stored = spark.createDataFrame([("same", 1, "a", True), ("newer", 1, "a", True), ("rehash", 1, "a", True), ("gone", 1, "a", True)], shape + ", indexed boolean")
    plan = lambda c: {r.path: r.action for r in refresh_plan(inventory, stored, c).collect()}
    assert plan(True) == {"newer": "index", "rehash": "index", "new": "index", "gone": "remove"} and "gone" not in plan(False)
    a, b = (spark.createDataFrame(x, "k long, t long, v string") for x in ([(1, 1, "a"), (2, 5, "b")], [(1, 2, "c"), (2, 4, "d")]))
    assert sorted((r.k, r.v) for r in upsert(a, b, "k", "t").collect()) == [(1, "c"), (2, "b")]


def test_the_stream_gives_the_tables_rollup(spark):
    stream = event_rollup(read_events(spark, SF))
    q = stream.writeStream.format("memory").queryName("rollup").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    table = event_rollup(spark.read.parquet(f"{SF}/events.parquet"))  # naive and UTC times print alike
    assert rows(spark.table("rollup").collect()) == rows(table.collect())


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_cascade_asks_in_order_and_ambiguity_gives_nothing(spark):
    shape = "node_id long, name string, file_id long, module string"
    c = spark.createDataFrame([(1, "f", 1, "m"), (2, "f", 2, "m"), (3, "g", 3, "n"), (4, "h", 4, "p"), (5, "h", 5, "q")], shape)
    q = spark.createDataFrame([(10, "f", 2, "z"), (11, "f", 9, "m"), (12, "g", 9, None), (13, "h", 9, "z"), (14, None, 1, "m")], "edge_id long, name string, file_id long, module string")
    found = {r.edge_id: (r.node_id, r.strategy) for r in resolution.cascade(q, c).collect()}
    assert found == {10: (2, "same_file"), 11: (1, "same_module"), 12: (3, "global_unique")}


def test_overrides_follow_inheritance_and_end_on_cycles(spark):
    e = edges(spark, ("MEMBER", 1, 11, None, None), ("MEMBER", 2, 12, None, None), ("MEMBER", 3, 13, None, None), ("INHERITANCE", 1, 2, None, None), ("INHERITANCE", 2, 3, None, None), ("INHERITANCE", 3, 1, None, None))
    n = spark.createDataFrame([(11, "METHOD", "A::run"), (12, "METHOD", "B::stop"), (13, "METHOD", "C::run")], "id long, kind string, serialized_name string")
    assert {(r.method, r.overridden) for r in resolution.overrides(Graph(n, e, None, None)).collect()} == {(11, 13), (13, 11)}


def test_updates_touch_only_their_edges(spark):
    e = edges(spark, ("CALL", 1, 2, None, None), ("CALL", 1, 3, 4, 0.9))
    u = spark.createDataFrame([(0, 7, 0.8)], "edge_id long, node_id long, confidence double")
    assert {(r.id, r.resolved_target, r.confidence) for r in resolution.apply_updates(e, u).collect()} == {(0, 7, 0.8), (1, 4, 0.9)}
