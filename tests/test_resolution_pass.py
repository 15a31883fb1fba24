"""The pass of resolution: common names, import bindings, tied and certain likely targets, owners, candidates kept, all kinds at once."""

from loomgraph.operators import resolution as r
from loomgraph.operators import resolution_pass as p
from loomgraph.sources.star_schema import Graph

CALL = "edge_id long, name string, target long, file_id long, module string, folder string, root string, owner string, member_call boolean"
NODE = "node_id long, name string, file_id long, module string, folder string, root string, owner string"


def call(i, name, target=0, file=1, folder="src/a", owner=None, member=False):
    return (i, name, target, file, folder, folder, folder.split("/")[0], owner, member)


def node(i, name, file=9, folder="src/b", owner=None):
    return (i, name, file, folder, folder, folder.split("/")[0], owner)


def resolved(spark, calls, nodes, bindings=(), semantic=(), policy=r.Policy()):
    rows = p.resolved_calls(
        spark.createDataFrame(calls, CALL), spark.createDataFrame(nodes, NODE), spark.createDataFrame([(b,) for b in bindings], "node_id long"), spark.createDataFrame(list(semantic), "edge_id long, node_id long, confidence double"), policy,
    )
    return {x.edge_id: (x.node_id, x.strategy, round(x.confidence, 2) if x.confidence is not None else None, x.candidates) for x in rows.collect()}


def test_calls(spark):
    nodes = [
        node(10, "clear", 2, "src/a"), node(11, "Parser::build"), node(12, "buildIndex", 3), node(13, "local", 1), node(14, "x::Local2", 1), node(15, "near", 4, "src/a"), node(16, "run", 5, "src/a", "Job"), node(17, "run", 6, "lib/c", "Job"),
        node(18, "stop", 7, "src/z", "Job"), node(19, "twice", 8, "src/z"), node(20, "twice", 9, "lib/q"), node(21, "make", 8, "lib/q", "Factory"), node(22, "clear", 1, "src/a"),
    ]
    calls = [
        call(1, "clear", file=5), call(2, "clear"), call(3, "build"), call(4, "buildIndex"), call(5, "local"), call(6, "local2"), call(7, "near"), call(8, "run", owner="Job"), call(9, "stop", owner="Job"), call(10, "twice"), call(11, "Factory::make"),
        call(12, "dispatch", target=77), call(13, "near", member=True), call(14, "gone", owner="Nobody"), call(15, "likely"), call(16, "tied"), call(17, "push", file=6, folder="q/q"), call(18, "pop", file=6, folder="q/q"),
    ]
    semantic = [(15, 88, 0.7), (15, 89, 0.6), (16, 88, 0.7), (16, 99, 0.7), (17, 88, 0.70), (18, 88, 0.85), (12, 88, 0.62), (1, 88, 0.7)]
    found = resolved(spark, calls, nodes, [77], semantic)
    assert found[1] == (None, None, None, [88, 10])  # a common name in the same module alone stays open, its candidates are kept
    assert found[2][:3] == (22, "same_file", 0.95)
    assert found[3][0] is None  # the last segment of another's method is no global match
    assert found[4][:3] == (12, "global_unique", 0.62)
    assert found[5][:2] == (13, "same_file") and found[6][:2] == (14, "same_file") and found[7][:3] == (15, "same_module", 0.8)
    assert found[8][:3] == (16, "same_module", 0.8) and found[9][:3] == (18, "root_owner", 0.95)
    assert found[10] == (None, None, None, []) and found[11][:3] == (21, "owner_alias", 0.95)
    assert found[12][:3] == (77, "import_binding", 0.95) and found[12][3] == [88, 77]
    assert found[13] == (None, None, None, []) and found[14][0] is None
    assert found[15] == (88, "semantic", 0.7, [88, 89]) and found[16] == (None, None, None, [88, 99])
    assert found[17][0] is None and found[18][:3] == (88, "semantic", 0.85)
    legacy = resolved(spark, calls, nodes, [77], semantic, r.Policy(legacy=True))
    assert legacy[2][0] is None and legacy[18][0] is None and legacy[5][0] == 13


def test_a_pass_over_all_kinds(spark):
    kinds = "id long, kind string, serialized_name string, qualified_name string, canonical_id string, start_line long, end_line long, file_id long"
    nodes = [(1, "CLASS", "Parent", 1), (2, "CLASS", "Own", 2), (3, "METHOD", "Base::draw", 1), (4, "METHOD", "Own::draw", 2), (5, "METHOD", "helper", 2), (6, "MODULE", "./base", 2), (7, "MODULE", "base", 1), (8, "METHOD", "draw", 3)]
    node_frame = spark.createDataFrame([(i, k, n, n, f"x:{i}", 1, 2, f) for i, k, n, f in nodes], kinds)
    shape = "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string, file_id long, line long, target_name string, caller_path string"
    edges = [
        (1, "MEMBER", 1, 3, None, None, None, None, 1), (2, "MEMBER", 2, 4, None, None, None, None, 2), (3, "INHERITANCE", 2, 1, None, None, None, None, 2), (4, "OVERRIDE", 4, 4, None, None, None, None, 2), (5, "CALL", 4, 5, None, None, None, None, 2),
        (6, "CALL", 4, 5, None, 3, 0.3, None, 2), (7, "CALL", 4, 5, None, 5, 0.9, None, 2), (8, "IMPORT", 2, 6, None, None, None, None, 2), (9, "CALL", 8, 5, None, None, None, None, 3), (10, "USAGE", 4, 4, None, None, None, None, 2),
    ]
    names = {n[0]: n[2] for n in nodes}
    edge_frame = spark.createDataFrame([(*e, 1, names[e[3]], "src/own.ts") for e in edges], shape)
    files = spark.createDataFrame([(1, "src/base.ts", "typescript"), (2, "src/own.ts", "typescript"), (3, "lib/x.ts", "typescript")], "id long, path string, language string")
    g = Graph(node_frame, edge_frame, None, files)
    css = (spark.createDataFrame([(10, "--a", 1)], "edge_id long, name string, part long"), spark.createDataFrame([(7, "--a", 2)], "node_id long, name string, part long"), spark.createDataFrame([(1, 1), (2, 1)], "id long, root long"))
    out = p.resolve(g, p.Known(references=css))
    got = {x.id: (x.resolved_target, x.certainty) for x in out.graph.edge.collect()}
    assert len(got) == len(edges) and got[4] == (3, "certain") and got[5] == (5, "certain") and got[6] == (5, "certain") and got[7][0] == 5 and got[10] == (7, "certain")
    assert got[8][0] == 7 and got[9] == (5, "probable"), (got[8], got[9])
    assert {x.kind: (x.open, x.resolved) for x in out.totals.collect()}["CALL"] == (3, 3)
    scoped = p.resolve(g, files=spark.createDataFrame([(3,)], "file_id long"))
    assert {x.edge_id for x in scoped.updates.where("node_id is not null").collect()} == {9}
