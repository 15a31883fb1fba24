"""Walks on stored adjacency, the ways between two nodes against a plain queue, and look-ups by trigrams and names."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import adjacency, grams, ranks, shortest, traverse
from loomgraph.sources import store
from loomgraph.sources.star_schema import BASE, Graph, load_graph

SF = "/root/testdata/sf0.001"
EDGE = "id long, kind string, source long, target long, resolved_source long, resolved_target long, confidence double, certainty string, file_id long, target_name string, caller_path string"


def graph(spark, edges, nodes=None):
    rows = [(i, "CALL" if i % 3 else "MEMBER", a, b, None, None, None, None, 1, f"t{b}", "src/a.rs") for i, (a, b) in enumerate(edges, 1)]
    ids = sorted({x for e in edges for x in e} | set(nodes or ()))
    node = spark.createDataFrame([(i, "FUNCTION" if i % 2 else "CLASS") for i in ids], "id long, kind string")
    return Graph(node, spark.createDataFrame(rows, EDGE), None, None)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_step_reads_its_slots_alone(spark):
    g = load_graph(spark, SF)
    own = adjacency.adjacency_of(g.edge)
    assert own.outgoing.slots >= 1 and adjacency.adjacency_of(g.edge).outgoing is own.outgoing
    for direction in ("outgoing", "incoming", "both"):
        step = own.steps(direction).at([1 * BASE + 1, 3 * BASE + 10])
        text = plan(step)
        assert re.search(r"PartitionFilters: \[.*slot#\d+ (IN|=)", text) and re.search(r"PushedFilters: \[.*In\(at, ?\[", text) and "Exchange" not in text
    # Frames made of the stored edges have other edges, so they do not read its adjacency.
    few = adjacency.adjacency_of(g.edge.where("kind = 'MEMBER'"))
    assert few.outgoing.slots == 0 and few.steps("outgoing").at([1 * BASE + 1]).where("kind <> 'MEMBER'").isEmpty()


def test_a_hot_node_is_dealt_over_files_and_found_whole(spark, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 20)
    edges = [(7, i) for i in range(100, 300)] + [(i, i + 1) for i in range(20)]
    frame = graph(spark, edges).edge
    rows = adjacency._ends(frame)[0]
    stored = store.by_slots(rows, "at", len(edges), 50, "id", within=("id", "next"))
    files = stored.at([7]).select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1 and stored.slots > 1
    assert sorted(r.next for r in stored.at([7]).collect()) == sorted(b for a, b in edges if a == 7)
    for n in (1, store.LOOKED_UP + 1, store.BROADCAST + 1):
        there = stored.beside(spark.createDataFrame([(7, 5), (3, 6)], "id long, ord long"), n, "id").collect()
        assert sorted((r.at, r.next, r.ord) for r in there) == sorted((a, b, 5 if a == 7 else 6) for a, b in edges if a in (3, 7))


def plain_ways(edges, source, target, depth, max_nodes, visited):
    """The nodes, path and edges between two nodes, by queues."""
    out, back = defaultdict(list), defaultdict(list)
    for i, (a, b) in enumerate(edges, 1):
        out[a].append((i, b))
        back[b].append((i, a))
    per_node, most, cut = max(3 * max_nodes, 128), depth or 10**9, False

    def walk(start, near, room):
        seen, queue, cut = {start: 0}, [start], False
        for at in queue:
            if len(seen) >= visited:
                return seen, True
            if seen[at] >= most:
                continue
            own = sorted(near[at])[:per_node]
            cut |= len(own) >= per_node
            for _, b in own:
                if b not in seen and room(b, seen[at] + 1):
                    seen[b] = seen[at] + 1
                    queue.append(b)
        return seen, cut

    ahead, cut = walk(source, out, lambda b, d: True)
    if target not in ahead:
        return None
    behind, more = walk(target, back, lambda b, d: b in ahead and ahead[b] + d <= most)
    inside = {i for i in ahead if i in behind and ahead[i] + behind[i] <= most} | {source, target}
    path = [source]
    while path[-1] != target:
        at = path[-1]
        nexts = [(behind[b], b) for _, b in sorted(out[at])[:per_node] if ahead.get(b) == ahead[at] + 1 and b in behind and b in inside and ahead[at] + 1 + behind[b] <= most]
        if not nexts:
            break
        path.append(min(nexts)[1])
    far = 10**9
    chosen = list(dict.fromkeys([*path, target]))
    for i in sorted(inside, key=lambda i: (ahead[i] + behind.get(i, far), ahead[i], i)):
        if len(chosen) < max_nodes and i not in chosen:
            chosen.append(i)
    kept = {i for a in chosen for i, b in sorted(out[a])[:per_node] if b in chosen and b in behind and ahead[a] + 1 + behind[b] <= most}
    return sorted((i, ahead[i]) for i in chosen), path, kept, cut or more or len(inside) > max_nodes or len(chosen) < len(inside)


@pytest.mark.parametrize("seed", range(4))
def test_ways_equal_a_plain_queue(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randint(0, 40), rnd.randint(0, 40)) for _ in range(110)] + [(40, 41), (41, 42)]
    g = graph(spark, edges)
    for depth, most, visited in ((0, 100, 400), (4, 100, 400), (0, 6, 400), (0, 100, 15), (3, 10, 25))[seed % 2 :: 2]:
        source, target = rnd.randint(0, 40), rnd.choice([rnd.randint(0, 40), 42])
        found, want = shortest.ways(g, source, target, depth, most, visited=visited), plain_ways(edges, source, target, depth, most, visited)
        nodes = sorted((r.id, r.depth) for r in found.trail.nodes.collect())
        if want is None:
            assert found.path.count() == 0 and {i for i, _ in nodes} == {source, target}
            continue
        assert [r.id for r in found.path.orderBy("position").collect()] == want[1], (source, target, depth, most, visited)
        assert nodes == want[0] and {r.id for r in found.trail.edges.collect()} == want[2]
        assert found.trail.truncated == want[3]


def test_ways_to_oneself_and_to_nowhere(spark):
    g = graph(spark, [(1, 2), (2, 3), (2, 2)], [9])
    own = shortest.ways(g, 1, 1)
    assert [(r.position, r.id) for r in own.path.collect()] == [(0, 1)] and not own.trail.truncated
    away = shortest.ways(g, 3, 1)
    assert away.path.count() == 0 and sorted((r.id, r.depth) for r in away.trail.nodes.collect()) == [(1, None), (3, 0)]
    gone = shortest.ways(g, 77, 1)
    assert [(r.id) for r in gone.trail.nodes.collect()] == [1]
    kinds = shortest.ways(g, 1, 3, node_kinds=["CLASS"])
    assert {r.id for r in kinds.trail.nodes.collect()} == {1, 2, 3}


def test_filters_of_steps(spark):
    g = graph(spark, [(1, 2), (1, 3), (2, 2), (3, 1)])
    g.edge = g.edge.withColumn("target_name", F.when(F.col("id") == 1, "push").otherwise(F.col("target_name"))).withColumn("caller_path", F.when(F.col("id") == 4, "tests/a.rs").otherwise(F.col("caller_path")))
    near = lambda direction, **f: sorted(r.id for r in adjacency.adjacency_of(g.edge).steps(direction, **f).at([1, 2, 3]).collect())
    assert near("outgoing") == [1, 2, 3, 4] and near("both") == [1, 1, 2, 2, 3, 4, 4]
    assert near("outgoing", kinds=["MEMBER"]) == [3] and near("outgoing", tests=False) == [1, 2, 3] and near("outgoing", utility=False) == [2, 3, 4]
    assert sorted((r.id, r.depth) for r in traverse.trail(g.edge, 3, 0).collect()) == [(1, 1), (2, 2), (3, 0)]


def test_text_hits_by_postings_equal_a_scan(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
    rows = [(i, f"{word()}/{word()}.rs", "\n".join(" ".join(word() for _ in range(rnd.randint(0, 6))) for _ in range(rnd.randint(0, 5)))) for i in range(120)] + [(500, "a\\b", ""), (501, "", "abc"), (502, "x", "z" * 5000 + "abcab")]
    texts = spark.createDataFrame(rows, "seq long, path string, text string")
    index = grams.build_grams(texts, slot_rows=20)
    for query, terms in (("abc", ["ab", "cab", "é"]), ("ca b", ["abcd"]), ("a", ["bb", "cc"]), ("abcab", ["zzz", "abc", "cab"]), ("nowhere", ["never", "not"]), ("b\na", ["dd", "ee", "ab", "cd"])):
        scan = ranks.text_hits(texts, query, terms, 50).collect()
        assert sorted(map(tuple, grams.indexed_text_hits(index, query, terms, 50).collect())) == sorted(map(tuple, scan)), query
    text = plan(index.postings.where(F.col("gram").isin(["abc", "bca"])))
    assert "PushedFilters: [In(gram, [abc,bca])]" in text


def plain_score(name, query):
    """The fold of ``subsequence_score``, one character after another."""
    kind = lambda c: 0 if c.isspace() else 1 if c in "/,:;|" else 5 if c.isnumeric() else 4 if c.isupper() else 3 if c.isalpha() else 2
    none, best, before = -(1 << 20), -(1 << 20), 0
    at = [(none, 0, none)] * len(query)
    for c in name:
        own = kind(c)
        place = (10, 9, 8)[before] if own > 2 and before <= 2 else 5 if (before == 3 and own == 4) or (before != 5 and own == 5) else 8 if own == 2 else 10 if own == 0 else 0
        fresh = []
        for j, (now, run, then) in enumerate(at):
            score, kept = none, 0
            if c.lower() == query[j].lower():
                if j == 0:
                    score, kept = 16 + 2 * place, place
                else:
                    last_now, last_run, last_then = at[j - 1]
                    last_run = place if place >= 8 and place > last_run else last_run
                    joined, apart = last_now + max(place, last_run, 4), last_then + place
                    score, kept = max(16 + max(joined, apart), none), last_run if joined >= apart else place
            fresh.append((score, kept, max(now - 3, then - 1, none)))
        at, before, best = fresh, own, max(best, fresh[-1][0])
    return best if best > 0 else None


def test_fuzzy_names(spark):
    rnd = random.Random(6)
    names = ["".join(rnd.choice("abAB_:/1 é") for _ in range(rnd.randint(1, 12))) for _ in range(150)] + ["load_graph_file", "LoadGraphFile", "loadgraph", "crate::load", "load::x", "load", "len", "x"] + ["len"] * 20
    nodes = spark.createDataFrame(list(enumerate(names)) + [(999, None)], "id long, name string")
    index = grams.build_names(nodes)
    for query in ("ab", "lgf", "load", "a1", "é", "zz", "b_a", "LEN"):
        got = [(r.id, r.name, r.score) for r in grams.fuzzy_symbols(index, query, 500).collect()]
        assert sorted(got) == sorted((i, n, plain_score(n, query)) for i, n in enumerate(names) if plain_score(n, query) is not None), query
        assert query != "load" or [n for _, n, _ in got[:3]] == ["load", "crate::load", "load::x"]
    assert len(grams.fuzzy_symbols(index, "len", 5).collect()) == 5
    assert grams.fuzzy_symbols(index, " ", 5).count() == 0
