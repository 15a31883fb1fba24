"""Budgeted trails against a plain queue, and what else SQL does not reach."""

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import inventory, relational, resolution, roots, search, traverse
from loomgraph.plans import exports, planner
from loomgraph.sources.star_schema import Graph

EDGE = "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string, file_id long, line long, target_name string, caller_path string"
NODE = "id long, kind string, serialized_name string, qualified_name string, canonical_id string, start_line long, end_line long, file_id long"


def graph(spark, edges, n, names=None):
    nodes = [(i, "METHOD" if i % 3 else "CLASS", (names or {}).get(i, f"n{i}"), f"q::n{i}", f"c:{i}", i, i + 2, 1) for i in range(n)]
    rows = [(k, kind, a, b, None, None, c, None, 1, k, (names or {}).get(b, f"n{b}"), path) for k, (kind, a, b, c, path) in enumerate(edges)]
    files = spark.createDataFrame([(1, "src/a.rs", "rust", True, True, 10)], "id long, path string, language string, indexed boolean, complete boolean, size long")
    return Graph(spark.createDataFrame(nodes, NODE), spark.createDataFrame(rows, EDGE), spark.createDataFrame([], "element_id long, file_id long, line long, end_line long, seq long"), files)


def plain_walk(edges, root, depth, direction, max_nodes, exists):
    """The walk as a queue takes it, an edge at a time."""
    budget = max(3 * max_nodes, 128)
    seen, queue, nodes, kept, cut = {root: 0}, deque([root]), [], [], False
    while queue and not cut:
        at = queue.popleft()
        if len(nodes) >= max_nodes:
            cut = True
            break
        nodes.append(at)
        if depth and seen[at] >= depth:
            continue
        if len(kept) >= budget:
            cut = True
            break
        own = [(k, b if a == at and direction != "incoming" else a) for k, (_, a, b, *_) in enumerate(edges) if (direction != "incoming" and a == at) or (direction != "outgoing" and b == at)]
        room = budget - len(kept)
        cut = len(own) > room
        for k, other in own[:room]:
            kept.append(k)
            if other not in seen:
                seen[other] = seen[at] + 1
                queue.append(other)
    return {x: seen[x] for x in nodes if x in exists}, kept, cut


@pytest.mark.parametrize("direction,depth,most", [("outgoing", 3, 500), ("incoming", 2, 500), ("both", 2, 20), ("outgoing", 0, 7), ("both", 0, 60)])
def test_trails_stop_where_a_queue_does(spark, direction, depth, most):
    rng = np.random.default_rng(most)
    edges = [("CALL", int(a), int(b), None, "src/a.rs") for a, b in rng.integers(0, 40, (300, 2))]
    g = graph(spark, edges, 38)  # nodes 38 and 39 are only named by edges
    t = traverse.budgeted_trail(g, 3, depth, direction, most)
    nodes, kept, cut = plain_walk(edges, 3, depth, direction, most, set(range(38)))
    assert {r.id: r.depth for r in t.nodes.collect()} == nodes and t.truncated == cut
    inside = [k for k in kept if edges[k][1] in nodes and edges[k][2] in nodes]
    assert sorted(r.id for r in t.edges.collect()) == sorted(inside) and t.omitted == len(kept) - len(inside)


def test_trail_filters(spark):
    edges = [("CALL", 0, 1, None, "src/a.rs"), ("CALL", 0, 2, None, "tests/a.rs"), ("USAGE", 0, 4, None, "src/a.rs"), ("CALL", 0, 5, 0.9, "src/a.rs"), ("CALL", 5, 5, 0.3, None), ("CALL", 5, 7, 0.3, None), ("CALL", 5, 7, 0.3, None)]
    g = graph(spark, edges, 9, {5: "push"})
    ids = lambda **k: {r.id for r in traverse.budgeted_trail(g, 0, 2, "outgoing", **k).nodes.collect()}
    assert ids() == {0, 1, 2, 4, 5, 7} and ids(tests=False) == {0, 1, 4, 5, 7} and ids(utility=False) == {0, 1, 2, 4} and ids(kinds=["USAGE"]) == {0, 4} and ids(node_kinds=["METHOD"]) == {0, 1, 2, 4, 5, 7}
    t = traverse.budgeted_trail(g, 0, 3)
    calm = traverse.without_noise(traverse.budgeted_trail(g, 0, 3, "outgoing"))
    assert sorted(r.id for r in calm.edges.collect()) == [0, 1, 2, 3, 5] and calm.omitted == 2 and not t.truncated
    sure = traverse.without_speculation(traverse.budgeted_trail(g, 0, 3, "outgoing"))
    assert {r.id for r in sure.nodes.collect()} == {0, 1, 2, 4, 5} and sure.omitted == 3


def test_paths_and_components(spark):
    e = graph(spark, [("CALL", a, b, None, None) for a, b in ((0, 1), (1, 4), (0, 2), (2, 3), (3, 4), (5, 6))], 7).edge
    at = lambda depth: {(r.id, r.depth) for r in traverse.path_subgraph(e, 0, 4, depth).collect()}
    assert at(2) == {(0, 0), (1, 1), (4, 2)} and at(3) == at(0) == {(0, 0), (1, 1), (2, 1), (3, 2), (4, 2)}
    assert {(r.id, r.root) for r in traverse.components(e.select(F.col("source").alias("a"), F.col("target").alias("b"))).collect()} == {(i, 0) for i in range(5)} | {(5, 5), (6, 5)}


def test_impact_tells_the_strongest_weakest_link(spark):
    g = graph(spark, [("CALL", 1, 0, 0.9, None), ("CALL", 2, 1, 0.6, None), ("MEMBER", 3, 1, None, None), ("CALL", 2, 1, 0.95, None)], 4)
    rows = {r.id: (r.distance, r.confidence, r.edge_id) for r in traverse.impact_evidence(g.edge, g.node.where("id = 0").select("id"), 5).collect()}
    assert rows == {0: (0, "direct", None), 1: (1, "certain", 0), 2: (2, "certain", 3), 3: (2, "certain", 2)}


def test_diversified_order():
    items = [dict(id=i, pinned=p, subsystem=s, name=n) for i, (p, s, n) in enumerate([(False, "a", "x"), (True, "b", "y"), (False, "a", "z"), (False, "b", "w"), (False, "c", "x"), (False, "c", "y"), (False, "c", "v")])]
    assert [x["id"] for x in roots.diversified(items)] == [1, 0, 6, 2, 3, 4, 5]


def test_queries_are_read():
    assert planner.query_tokens("How does HTTPServer route getUser_name?") == ["http", "server", "route", "get", "user", "name"]
    assert planner.quoted_tokens('find `loadGraph` and "two words"') == ["load", "graph", "two", "words"]
    assert [planner.required_matches(n) for n in range(1, 9)] == [1, 2, 2, 2, 2, 3, 3, 4]
    assert planner.token_weight(0, 10**9) == 5.0 and planner.token_weight(99, 99) == 1.0
    intent = planner.parse_intent("kind:fn path:src/ open the 'door' lang:rust x:")
    assert intent.text == "open the 'door' x:" and intent.filters == [("kind", "fn"), ("path", "src/"), ("language", "rust")]
    assert planner.parse_intent("name:Quay kind:type").text == "Quay" and planner.parse_intent("kind:type").text == "type"
    assert planner.plan(planner.classify("src/x.rs"), full=False) == []


def test_cosine_refuses_and_skips(spark):
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [1.0]), (6, [1.0, None]), (7, None)], "id long, embedding array<double>")
    assert [(r.id, r.score) for r in search.cosine_top(v, [3.0, 0.0], 9, 0.3, 0.5).collect()] == [(1, 1.0), (2, 0.707107)]
    with pytest.raises(ValueError):
        search.cosine_top(v, [0.0, 0.0], 9)
    assert [r.id for r in search.unit_vectors(spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0, 1.0]), (3, None)], "id long, embedding array<double>")).collect()] == [1]


def test_exports(spark):
    g = graph(spark, [("CALL", 0, 1, 0.9, None), ("CALL", 1, 2, 0.9, None)], 3, {1: 'say "hi"'})
    lines = {r.id: r.line for r in exports.dot_lines(relational.neutralised(g.edge)).collect()}
    assert lines[0] == '"0" -> "1" [label="CALL"];'
    chart = [r.line for r in exports.mermaid_lines(g.node.select("id", F.col("serialized_name").alias("name")), relational.neutralised(g.edge)).orderBy("part", "id").collect()]
    assert chart[1] == 'n1["say #quot;hi#quot;"]' and chart[3] == "n0 -->|CALL| n1"
    assert exports.json_rows(g).count() == 5 and "| q::n1 | METHOD | 1 | 1 |" in exports.markdown_report(g)


def test_listing_is_whole_or_none(spark):
    f = spark.createDataFrame([("b",), ("a",), ("a",)], "path string")
    assert [r.path for r in inventory.bounded_listing(f, 2).collect()] == ["a", "b"] and inventory.bounded_listing(f, 1) is None


def test_entry_points_fall_back_to_callables(spark):
    g = graph(spark, [("CALL", 1, 2, 0.9, None), ("CALL", 2, 1, 0.9, None)], 3)
    assert {r.id for r in relational.entry_points(g).collect()} == {1, 2}


def test_stale_calls_keep_protected_targets_and_null_confidence(spark):
    nodes = spark.createDataFrame([(1, "openapi:endpoint:x", "f"), (2, "c", "f"), (3, "c", "Len"), (4, None, "g")], "id long, canonical_id string, serialized_name string")
    rows = [(0, "CALL", 9, 1, None, 5, 0.2, None), (1, "CALL", 9, 2, None, 5, 0.2, None), (2, "CALL", 9, 3, None, 5, None, None), (3, "CALL", 9, 3, None, 5, 0.9, None), (4, "CALL", 9, 4, None, 5, None, None), (5, "USAGE", 9, 2, None, 5, 0.2, None)]
    e = spark.createDataFrame(rows, "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string")
    assert {r.id for r in resolution.stale_cleanup(e, nodes).where("resolved_target is not null").collect()} == {0, 3, 4, 5}


def test_whole_ways_pass_what_the_caps_of_a_walk_leave_out(spark, monkeypatch):
    from loomgraph.operators import shortest

    # The way to 200 is the last of 150 edges, more than a capped walk follows; 201 lies beside it by two edges.
    edges = [("CALL", 0, i, None, "src/a.rs") for i in range(1, 151)] + [("CALL", 150, 200, None, "src/a.rs"), ("CALL", 150, 201, None, "src/a.rs"), ("CALL", 201, 200, None, "src/a.rs")]
    g = graph(spark, edges, 202)
    assert shortest.ways(g, 0, 200, 4, 10).path.isEmpty()
    whole = shortest.ways(g, 0, 200, 4, 10, whole=True)
    assert [r.id for r in whole.path.orderBy("position").collect()] == [0, 150, 200]
    assert sorted(r.id for r in whole.trail.edges.collect()) == [149, 150, 151, 152] and not whole.trail.truncated
    assert {r.id: r.depth for r in whole.trail.nodes.collect()} == {0: 0, 150: 1, 200: 2, 201: 2}
    monkeypatch.setattr(shortest, "MOST_VISITED", 3)
    assert not shortest.ways(g, 0, 200, 0, 10, whole=True).path.isEmpty()
    # Beyond the depth that is left nothing is kept, and parallel edges stay.
    near = shortest.ways(graph(spark, edges + [("USAGE", 150, 200, None, "src/a.rs")], 202), 0, 200, 2, 10, whole=True).trail
    assert sorted(r.id for r in near.edges.collect()) == [149, 150, 153] and near.nodes.count() == 3


def test_the_path_queries_have_no_cap(spark, monkeypatch):
    from loomgraph.operators import shortest
    from loomgraph.plans import queries_walks

    calls = []
    monkeypatch.setattr(queries_walks, "ways", lambda *a, **k: calls.append(k) or shortest.Ways(traverse.Trail(spark.range(0).selectExpr("id", "0 as depth", "0 as ord"), spark.range(0).selectExpr("id", "'' as kind", "id as src", "id as dst"), False, 0), spark.range(0)))
    monkeypatch.setattr(queries_walks, "load_graph", lambda *a: None)
    for name in ("path_steps", "path_steps_of_any_length", "path_nodes", "path_edges"):
        queries_walks.ALL[name][0](spark, "")
    assert len(calls) == 4 and all(k == {"whole": True} for k in calls)


def test_ranges_met_often_are_dealt_over_lanes(spark, monkeypatch):
    monkeypatch.setattr(inventory, "LANE_PAIRS", 100)
    rng = np.random.default_rng(3)
    occ = [(int(f), int(a), int(a + b), k) for k, (f, a, b) in enumerate(rng.integers(0, [3, 150, 4], (200, 3)))] + [(9, 70, 71, 1000 + k) for k in range(300)] + [(None, 70, 71, 5000), (9, None, 71, 5001)]
    spans = [(int(f), int(k), int(a), int(a + n)) for k, (f, a, n) in enumerate(rng.integers(0, [3, 150, 90], (100, 3)))] + [(9, 500 + k, 70 - k % 3, 71 + k % 2) for k in range(40)]
    o, s = spark.createDataFrame(occ, "file_id long, line long, end_line long, seq long"), spark.createDataFrame(spans, "file_id long, node_id long, start_line long, end_line long")
    want = sorted((n, q) for f, a, b, q in occ for g, n, i, j in spans if f == g and a is not None and a >= i and b <= j)
    assert sorted(tuple(r) for r in inventory.range_contained(o, s).collect()) == want
    assert sorted(r.seq for r in inventory.range_covered(o, s).collect()) == sorted({q for _, q in want})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = inventory.range_contained(o.where("file_id = 9"), s.where("file_id = 9"))
        sizes = [r["count"] for r in hot.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 300 * 40 and len(sizes) > 1


def test_what_tiles_repeat_stays_below_the_ranges_rows(spark, monkeypatch):
    monkeypatch.setattr(inventory, "LANE_PAIRS", 10)
    monkeypatch.setattr(inventory, "LANE_SPANS", 50)
    o = spark.range(900).selectExpr("9L as file_id", "70L as line", "71L as end_line", "if(id = 5, null, id) as seq")
    s = spark.range(120).selectExpr("9L as file_id", "if(id = 7, null, id) as node_id", "70L as start_line", "71L as end_line")
    dealt, lists, _ = inventory._tiles(o, s)
    sizes = [r.n for r in lists.selectExpr("size(ids) as n").collect()]
    # Three chunks of spans, each beside at most 900 / 50 lanes: not a list for each 10 pairs.
    assert max(sizes) < 70 and len(sizes) == 3 * 18 and sum(sizes) == 120 * 18 and dealt.count() == 900 * 3
    pairs = inventory.range_contained(o, s)
    assert pairs.count() == pairs.distinct().count() == 900 * 120 and pairs.where("seq is null").count() == 120 and pairs.where("node_id is null").count() == 900
