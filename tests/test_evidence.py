"""Evidence of packets: support in order and without repeats, options that are offered once, and what each packet comes to."""

import pytest

from loomgraph.operators import evidence as e
from loomgraph.plans import queries_evidence

SHAPES = {
    "packets": "packet long, question string, fresh boolean, error boolean, pinned boolean, drilled boolean, truncated boolean, ambiguous string",
    "citations": "packet long, ord long, node_id string, name string, path string, line long, eligible boolean",
    "ranges": "packet long, id string, node_id string, path string, start_line long, end_line long, snippet string",
    "edges": "packet long, ord long, id string, kind string, source string, target string",
    "searches": "packet long, ord int, query string, completion string, resolved long, candidates long, blocking int",
    "claims": "packet long, ord int, id string, kind string, material boolean, bound boolean, status string, edge_kind string, edge_proofs long, node_id string, path string, probe_path string, reason string",
    "coverage": "packet long, path string, status string, reason string",
    "probes": "packet long, ord int, path string",
}


def packet(i, question="explain it", fresh=True, error=False, pinned=True, drilled=False, truncated=False, ambiguous=None):
    return (i, question, fresh, error, pinned, drilled, truncated, ambiguous)


def claim(i, name="flow", kind="dispatch", material=True, bound=False, status="reported", edge=None, proofs=0, node=None, path=None, probe=None, reason=None, ord=0):
    return (i, ord, name, kind, material, bound, status, edge, proofs, node, path, probe, reason)


@pytest.fixture(scope="module")
def compiled(spark):
    rows = {
        "packets": [
            packet(1), packet(2), packet(3), packet(4, drilled=True), packet(5, fresh=False), packet(6, ambiguous="probe-0"), packet(7), packet(8), packet(9, truncated=True), packet(10, "see `src/a.rs`, or (lib/b.ts); x/y"),
            packet(11, drilled=True), packet(12), packet(13, pinned=False, ambiguous="probe-1"), packet(14, error=True), packet(15), packet(16),
        ],
        "citations": [(1, 2, "n1", "Router", "src/a.rs", 10, True), (1, 5, "n1", "Router again", "src/a.rs", 11, True), (1, 1, "n2", "Plain", None, None, True), (1, 3, "n3", "Skipped", "x", 1, False), (4, 0, "n1", "R", "src/a.rs", 1, True), (7, 0, "n1", "R", "src/a.rs", 1, True), (8, 0, "n1", "R", "src/a.rs", 1, True), (10, 0, "n1", "R", "src/a.rs", None, True), (12, 0, "n1", "R", "p", 1, True), (16, 0, "n1", "R", "p", 1, True)],
        "ranges": [(1, "source:n1:10", "n1", "src/a.rs", 10, 11, "fn f() {}"), (1, "source:n2", "n2", "b", 1, 2, ""), (8, "source:n1", "n1", "src/a.rs", 1, 2, "x")],
        "edges": [(1, 1, "e1", "CALL", "a", "b"), (1, 2, "e2", "MEMBER", "a", "c"), (1, 3, "e1", "CALL", "a", "b")],
        "searches": [(1, 0, "nothing", "completed", 0, 0, 0), (1, 1, "some", "completed", 1, 1, 0), (3, 0, "none", "completed", 0, 0, 0), (9, 0, "lost", "cancelled", 0, 0, 0), (15, 0, "dead", "cancelled", 0, 2, 1)],
        "claims": [
            claim(1, status="proven"), claim(2, node="n9", edge="CALL"), claim(2, "second", node="n9", ord=1), claim(4, node="n9"), claim(12, "named", "exact_probe", bound=False), claim(16, reason="named_sql_table_carriers_missing:t", node="n1"),
            claim(11, status="proven"), claim(3, material=False),
        ],
        "coverage": [(7, "src/a.rs", "incomplete", "parser_partial"), (8, "src/a.rs", "incomplete", "parser_partial"), (1, "src/a.rs", "complete", None)],
        "probes": [(9, 0, "src/z.rs"), (10, 0, "src/a.rs")],
    }
    own = e.Evidence(**{name: spark.createDataFrame(rows[name], shape) for name, shape in SHAPES.items()})
    support, options = e.support_units(own), e.drill_options(own)
    return own, support, options, e.dispositions(own, support, options)


def test_support(compiled):
    of_one = [(r.id, r.summary) for r in compiled[1].where("packet = 1").orderBy("place").collect()]
    assert of_one == [("symbol:n2", "Plain"), ("symbol:n1", "Router at src/a.rs:10"), ("source:n1:10", "source for n1 at src/a.rs:10-11"), ("edge:e1", "`a` CALL `b`"), ("negative:nothing", "searched `nothing`, zero hits")]
    assert [r.summary for r in compiled[1].where("packet = 10").collect()] == ["R at src/a.rs"]


def test_options(compiled):
    found = {}
    for r in compiled[2].orderBy("packet", "place").collect():
        found.setdefault(r.packet, []).append((r.option, r.target, r.gap))
    assert found[2] == [("omitted_mandatory_support", "n9", "omitted-edge:flow")]
    assert found[9] == [("deadline_lost_candidate", "lost", "deadline-lost:lost"), ("bounded_source_read", "src/z.rs", "named-path:src/z.rs")]
    # A path that is cited already is not offered, named or probed.
    assert found[10] == [("bounded_source_read", "lib/b.ts", "named-path:lib/b.ts")]
    assert set(found) == {2, 4, 9, 10}


def test_dispositions(compiled):
    found = {r.packet: (r.disposition, r.reason) for r in compiled[3].collect()}
    kinds = {i: d for i, (d, _) in found.items()}
    assert kinds == {
        1: "supported", 2: "drill_once", 3: "not_established", 4: "not_established", 5: "unavailable", 6: "not_established", 7: "unavailable", 8: "supported", 9: "drill_once", 10: "drill_once",
        11: "not_established", 12: "supported", 13: "unavailable", 14: "unavailable", 15: "unavailable", 16: "not_established",
    }
    assert found[3][1] == "searches found nothing" and found[11][1] == "the second round added no support" and found[16][1] == "claims are unproven"


def test_a_graph_shows_every_disposition(spark):
    found = {r.disposition for r in queries_evidence.ALL["evidence_dispositions"][0](spark, "/root/testdata/sf0.001").select("disposition").distinct().collect()}
    assert found == {"supported", "drill_once", "not_established", "unavailable"}


def test_support_is_shuffled_once_and_nothing_else_is_stored_for_it(spark, monkeypatch):
    written = []
    plain = queries_evidence.stored
    monkeypatch.setattr(queries_evidence, "stored", lambda df, *sort: written.append(df.columns) or plain(df, *sort))
    monkeypatch.setattr(queries_evidence, "kept", lambda spark, key, build: build())
    support = queries_evidence.ALL["evidence_support"][0](spark, "/root/testdata/sf0.001")
    assert support.columns == ["packet", "place", "id", "kind", "summary"] and support.count() == support.distinct().count() > 0
    # The calls and what they come to; the support itself is read, not kept.
    assert len(written) == 2
    assert support._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_support_keeps_the_least_of_units_that_share_an_id(spark, compiled):
    rows = {
        "citations": [(1, 4, "n", "b", "p", 1, True), (1, 4, "n", "a", "q", 9, True), (1, 6, "n", "A", "p", 1, True), (1, 3, "n", "never", "p", 1, False), (2, 0, None, "none", "p", 1, True)],
        "ranges": [(1, "r", "n", "p", 5, 6, "x"), (1, "r", "n", "p", 2, 9, "x"), (1, "r", "n", "p", 2, 9, "x"), (1, "empty", "n", "p", 1, 1, ""), (2, "of no node", None, "p", 1, 1, "x"), (1, "of another", "m", "p", 1, 1, "x")],
        "edges": [(1, 9, "r", "USAGE", "s", "t"), (1, 8, "r", "CALL", "s", "t"), (1, 1, "x", "MEMBER", "s", "t")],
        "searches": [(2, 0, "q", "completed", 0, 0, 0), (2, 1, "q", "completed", 0, 0, 0), (2, 2, "hit", "completed", 0, 1, 0)],
    }
    own = e.Evidence(**{name: spark.createDataFrame(rows.get(name, []), shape) for name, shape in SHAPES.items()})
    whole = [(r.packet, r.place, r.id, r.kind, r.summary) for r in e.support_units(own).orderBy("packet", "place").collect()]
    assert whole == [
        (1, 1, "symbol:n", "symbol_location", "a at q:9"), (1, 2, "r", "source_range", "source for n at p:2-9"), (1, 3, "edge:r", "typed_graph_edge", "`s` CALL `t`"),
        (2, 1, None, "symbol_location", "none at p:1"), (2, 2, "negative:q", "complete_query_negative", "searched `q`, zero hits"),
    ]
    assert [tuple(r) for r in e.support_units(own, "summary", 3).orderBy("packet", "place").collect()] == whole
