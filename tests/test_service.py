"""Publication, kept tables, the service, sources read from folders, and the streams' state."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import keyed, ranks
from loomgraph.plans.queries_service import service
from loomgraph.service import packet_queries, packet_terms
from loomgraph.sources import collectors, publish
from loomgraph.streaming.state import callable_deltas, publish_batches

SF = "/root/testdata/sf0.001"


def test_generations(spark, tmp_path):
    p = publish.Publisher(spark, f"file://{tmp_path}/g")
    files, errors = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 1), (2, None)], "id long, file_id long")
    with pytest.raises(publish.PublicationError):
        p.table("file")
    first = p.stage({"file": files, "error": errors})
    assert p.live() is None
    p.promote(first)
    second = p.stage({"file": files.limit(0), "error": errors.limit(0)}, base=first)
    p.promote(second)
    assert p.table("file").count() == 0
    p.roll_back()
    assert p.live() == first and p.table("error").count() == 2
    with pytest.raises(publish.PublicationError):
        p.roll_back()
    with pytest.raises(publish.PublicationError):
        p.discard(first)
    p.discard(second)
    with pytest.raises(publish.PublicationError):
        p.promote(second)
    with pytest.raises(publish.PublicationError):
        p.stage({"file": files, "error": errors.withColumn("file_id", F.lit(9).cast("long"))})


def test_dirty_paths():
    d = publish.DirtyPaths().changed("a", "b").begin().changed("c")
    assert d.running == {"a", "b"} and d.waiting == {"c"}
    with pytest.raises(publish.PublicationError):
        d.begin()
    assert d.finish(False).waiting == {"a", "b", "c"} and d.finish(True).waiting == {"c"}


def test_bookmarks_follow_their_symbols(spark):
    shape = "bookmark long, category long, node_id long, canonical_id string, file_id long, qualified_name string, kind string, signature string, note string"
    a = keyed.Annotations(keyed.Keyed(spark.createDataFrame([], shape), "bookmark"), keyed.Keyed(spark.createDataFrame([], "category long, name string"), "category"))
    a = a.create_category("to read").create_category("bugs").rename_category(2, "faults")
    with pytest.raises(ValueError):
        a.create_category("to read")
    anchor = "node_id long, canonical_id string, file_id long, qualified_name string, kind string, signature string"
    a = a.add(1, spark.createDataFrame([(5, "c:5", 1, "m::f", "METHOD", "s1"), (6, "c:6", 1, "m::g", "METHOD", "s2")], anchor), "see").add(2, spark.createDataFrame([(7, "c:7", 2, "m::h", "METHOD", "s3")], anchor))
    assert [(r.bookmark, r.category, r.node_id) for r in a.bookmarks.rows.orderBy("bookmark").collect()] == [(1, 1, 5), (2, 1, 6), (3, 2, 7)]
    now = spark.createDataFrame([(15, "c:x", 9, "m::f", "METHOD", "s1"), (16, "c:y", 1, "m::new", "METHOD", "s2")], anchor)
    moved = a.noted(1, "seen").rebound(now)
    assert [(r.bookmark, r.node_id, r.note) for r in moved.bookmarks.rows.orderBy("bookmark").collect()] == [(1, 15, "seen"), (2, 16, "see"), (3, None, "")]
    assert a.delete(2).bookmarks.rows.count() == 2 and a.delete_category(1).bookmarks.rows.count() == 1 and a.delete_category(1).categories.rows.count() == 1


def test_kept_tables(spark):
    t = keyed.Keyed(spark.createDataFrame([(1, 1, "a"), (2, 1, None)], "node_id long, file_id long, v string"))
    up = t.upsert(spark.createDataFrame([(2, 1, "b"), (2, 1, "c"), (3, 2, "d")], "node_id long, file_id long, v string"))
    assert sorted((r.node_id, r.v) for r in up.rows.collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert up.cleared().rows.count() == 0 and up.mismatched("v", "a") and not t.cleared().mismatched("v", "a")
    assert up.manifest("v").first()["digest"] == keyed.Keyed(up.rows.orderBy(F.desc("node_id"))).manifest("v").first()["digest"]


def test_the_service(spark):
    s = service(spark, SF)
    rows = s.search("Customer#000000010 kind:class", 3)
    assert rows[0]["name"] and s.search("Customer#000000010 kind:class", 3) is rows
    assert s.definition("Customer#000000010").first()["kind"] == "CLASS" and s.get_node(30_000_000_010).count() == 1
    assert s.status().count() == 5 and s.ground("strict").count() <= 20 and s.report(2).startswith("# Graph report")
    assert s.callees("no such symbol").nodes.count() == 0
    w = s.workflow("Customer#000000010")
    assert set(w) == {"dependents", "affected", "occurrences"} and s.trace("Customer#000000010").count() > 0
    plan = s.search_plan("where is Customer#000000010 used", 2)
    assert plan["subqueries"] and plan["hits"]
    assert s.bridges([(30_000_000_010, 30_000_000_010)]) == [(30_000_000_010, 30_000_000_010, "shared_file", 2)]
    packet = s.packet("which route calls `Customer#000000010`", 4, 200)
    assert packet["class"] == "route_tracing" and packet["terms"][0] == "Customer#000000010" and len(packet["citations"]) <= 4
    assert packet_queries("open src/a.rs and load_file")[1:3] == ["src/a.rs", "load_file"] and packet_terms("'x y' parser")[:2] == ["x y", "parser"]


def test_sources_from_folders(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "b.rs").write_text("fn main() {}")
    (tmp_path / "a.rs").write_text("x" * 50)
    found = collectors.discover(spark, str(tmp_path), "*.rs", 20).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.size, r.text) for r in found] == [("a.rs", 50, None), ("b.rs", 12, "fn main() {}")]
    commands = [{"directory": "/x", "file": "a.cc", "command": "cc -std=c++20 -Iinc -DA=1 -I lib a.cc"}, {"directory": "/x", "file": "b.cc", "arguments": ["cc", "-std=c11", "-DB"]}]
    (tmp_path / "compile_commands.json").write_text(json.dumps(commands))
    rows = {r.file: (r.standard, r.includes, r.defines) for r in collectors.compile_commands(spark, str(tmp_path / "compile_commands.json")).collect()}
    assert rows == {"a.cc": ("c++20", ["inc", "lib"], ["A=1"]), "b.cc": ("c11", [], ["B"])}


def test_collectors_on_odd_texts():
    for own in collectors.COLLECTORS.values():
        own("")
        own("\x00 <<EOF\n((((")
    assert collectors.json_keys('{"a": 1} {"b\\"c": 2}') == [("ANNOTATION", "key", "a", 1, None), ("ANNOTATION", "key", 'b\\"c', 1, None)]
    assert collectors.json_keys("")[0][1] == "malformed" and collectors.compose("a: 1") == [] and collectors.workflow("jobs:\n") == []
    assert [u[2] for u in collectors.markdown("~~~\n# a\n~~~~\n# b")] == ["b"]


def test_prefilter_and_names(spark):
    v = spark.createDataFrame([(i, [i / 50, 1 - i / 50]) for i in range(50)], "id long, embedding array<double>")
    assert [r.id for r in ranks.prefiltered_top(v, [1.0, 0.0], 3).collect()] == [49, 48, 47]
    n = spark.createDataFrame([(1, "LoadGraphFile"), (2, "http_server")], "id long, name string")
    assert [r.i for r in n.select(ranks.initials(F.col("name")).alias("i")).collect()] == ["lgf", "hs"]


def test_deltas_of_a_stream(spark, tmp_path):
    shape = "file_id long, symbol_key string, run long, signature_hash string, body_hash string, start_line long"
    for run, rows in enumerate([[(1, "f", 1, "s", "b", 1), (1, "g", 1, "s", "b", 9)], [(1, "f", 2, "s", "b2", 1), (1, "g", 2, "s", "b", 12), (1, "f", 3, "s2", "b3", 1)]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = callable_deltas(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    found = sorted((r.symbol_key, r.run, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert found == [("f", 1, "inserted"), ("f", 2, "body"), ("f", 3, "signature"), ("g", 1, "inserted"), ("g", 2, "moved")]


def test_batches_become_generations(spark, tmp_path):
    p = publish.Publisher(spark, f"file://{tmp_path}/g")
    for run in range(2):
        spark.createDataFrame([(run,)], "id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        publish_batches(spark.readStream.schema("id long").parquet(f"{tmp_path}/in"), p, "rows", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.batch) for r in p.table("rows").collect()) == [(0, 0), (1, 1)]
