"""Walks over the edges, level by level; what each level finds is written, so a lost executor costs one level."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import STRUCTURAL, certainty_of
from loomgraph.operators.adjacency import Steps, adjacency_of, plain_steps
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import written, written_rows

durable = written


def distances(starts: DataFrame, steps: Steps, depth: int, within: DataFrame | None = None) -> DataFrame:
    """(id, depth): least number of steps from any of ``starts`` (id); depth 0 means unlimited.

    ``within`` (id, room) confines the walk to its nodes, each at ``room`` steps at most. Only new
    nodes are written at each level; what was seen is the union of the levels' files.
    """
    frontier, fresh = written_rows(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    hop = 0
    while fresh and (depth == 0 or hop < depth):
        hop += 1
        found = steps.beside(frontier.select("id"), fresh).select(F.col("next").alias("id")).where("id is not null").distinct()
        if within is not None:
            found = found.join(within.where(F.col("room") >= hop).select("id"), "id", "left_semi")
        frontier, fresh = written_rows(found.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(hop)))
        seen = seen.unionByName(frontier) if fresh else seen
    return seen


def _start(edges: DataFrame, root: int) -> DataFrame:
    return edges.sparkSession.createDataFrame([(root,)], "id long")


def trail(edges: DataFrame, root: int, depth: int, direction: str = "outgoing") -> DataFrame:
    return distances(_start(edges, root), adjacency_of(edges).steps(direction), depth)


def path_subgraph(edges: DataFrame, source: int, target: int, depth: int) -> DataFrame:
    """(id, depth) of the nodes on paths of at most ``depth`` steps from source to target (0: any length).

    The walk back from the target stays among nodes that the source reaches, and at each within the
    steps that are left. Where no path leads, the two endpoints alone come back, the target without a depth.
    """
    adjacent = adjacency_of(edges)
    ahead = distances(_start(edges, source), adjacent.steps("outgoing"), depth)
    if ahead.where(F.col("id") == target).isEmpty():
        return edges.sparkSession.createDataFrame([(source, 0), (target, None)], "id long, depth int").distinct()
    room = F.lit(2**31 - 1) if depth == 0 else F.lit(depth) - F.col("depth")
    behind = distances(_start(edges, target), adjacent.steps("incoming"), depth, ahead.select("id", room.alias("room"))).withColumnRenamed("depth", "back")
    return ahead.join(behind.select("id"), "id", "left_semi")


@dataclass
class Trail:
    """Nodes (id, depth, ord) in the order of the walk, edges between them, whether a budget cut it, and how many edges were left out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool
    omitted: int
    root: int = 0
    kinds: list[str] = field(default_factory=list)


_KEPT = "id long, kind string, src long, dst long, certainty string, confidence double"


def budgeted_trail(g: Graph, root: int, depth: int = 1, direction: str = "outgoing", max_nodes: int = 500, kinds: list[str] | None = None, node_kinds: list[str] | None = None, tests: bool = True, utility: bool = True) -> Trail:
    """A breadth-first walk in a fixed order under budgets: ``max_nodes`` nodes, three edges a node (128 at least).

    Each level is one join of the frontier with the edges; of its edges, in the order of the frontier
    and then of edge ids, at most what is left of the budget comes to the driver, which needs the
    order to see where the walk stops. What the driver holds is bounded by ``max_nodes``.
    """
    spark = g.node.sparkSession
    steps = adjacency_of(g.edge).steps(direction, kinds, tests, utility)
    edge = F.struct(*[F.col(c.split()[0]) for c in _KEPT.split(", ")]).alias("edge")
    budget = max(3 * max_nodes, 128)
    depth_of, order, edges = {root: 0}, [root], []
    popped: list[int] = []
    truncated, frontier, level = False, [root], 0
    while frontier and not truncated:
        ends = level >= depth > 0
        found: dict[int, list] = {}
        left = budget - len(edges)
        if not ends and left:
            at = spark.createDataFrame(list(enumerate(frontier)), "ord long, at long")
            rows = steps.beside(at, len(frontier), "at").orderBy("ord", "id", "next").limit(left + 1).select("at", "next", edge).collect()
            for r in rows:
                found.setdefault(r["at"], []).append(r)
        nexts: list[int] = []
        for node in frontier:
            if len(popped) >= max_nodes:
                truncated = True
                break
            popped.append(node)
            if ends:
                continue
            room = budget - len(edges)
            own = found.get(node, [])
            if room == 0 or len(own) > room:
                truncated = True
            for r in own[:room]:
                edges.append(tuple(r["edge"]))
                if r["next"] not in depth_of:
                    depth_of[r["next"]] = level + 1
                    nexts.append(r["next"])
            if truncated:
                break
        frontier, level = nexts, level + 1
        order += nexts
    nodes = spark.createDataFrame([(n, depth_of[n], i) for i, n in enumerate(popped)], "id long, depth int, ord int")
    nodes = nodes.join(g.node.select("id", "kind"), "id", "left_semi" if not node_kinds else "inner")
    if node_kinds:
        nodes = nodes.where(F.col("kind").isin(node_kinds) | (F.col("id") == root)).drop("kind")
    kept = durable(spark.createDataFrame(edges, _KEPT).withColumn("ord", F.monotonically_increasing_id()))
    chosen = _between(kept, nodes)
    n = chosen.count()
    return Trail(nodes, chosen, truncated, len(edges) - n, root)


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes`` (id)."""
    ends = [nodes.select(F.col("id").alias(c)) for c in ("src", "dst")]
    return edges.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi")


def without_noise(t: Trail) -> Trail:
    """The trail without self edges and with one edge for each (src, dst, kind), the first."""
    kept = t.edges.where("src <> dst").groupBy("src", "dst", "kind").agg(F.min(F.struct("ord", "id", "certainty", "confidence")).alias("e")).select("src", "dst", "kind", "e.*")
    kept = durable(kept)
    return Trail(t.nodes, kept, t.truncated, t.omitted + t.edges.count() - kept.count(), t.root)


def speculative() -> Column:
    """Whether an edge is no more than a guess: uncertain or probable."""
    return F.coalesce(F.coalesce("certainty", certainty_of()).isin("uncertain", "probable"), F.lit(False))


def without_speculation(t: Trail) -> Trail:
    """The trail without speculative edges, and of that only what is still connected to its root."""
    sure = durable(t.edges.where(~speculative()))
    both = sure.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(sure.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    reach = distances(_start(t.edges, t.root), plain_steps(both), 0)
    nodes = t.nodes.join(reach.select("id"), "id", "left_semi")
    kept = durable(_between(sure, nodes))
    return Trail(nodes, kept, t.truncated, t.omitted + t.edges.count() - kept.count(), t.root)


#: The group of a trail's step by its edge kind; all others tell of types.
STORY = {"CALL": "runtime", "MACRO_USAGE": "runtime", "USAGE": "data", "INCLUDE": "data", "IMPORT": "data", "ANNOTATION": "data"}


def story(edges: DataFrame, most: int = 16) -> DataFrame:
    """(group, src, kind, dst, certainty, place): a trail's distinct steps by group, at most ``most`` each, by their first edge."""
    from pyspark.sql import Window

    group = reduce(lambda w, k: w.when(F.col("kind") == k, STORY[k]), STORY, F).otherwise("type")  # type: ignore[arg-type]
    certainty = F.coalesce("certainty", certainty_of(), F.when(F.col("kind").isin(*STRUCTURAL), "certain"), F.lit(""))
    steps = edges.groupBy("src", "kind", "dst", certainty.alias("certainty")).agg(F.min("id").alias("first")).withColumn("group", group)
    place = F.row_number().over(Window.partitionBy("group").orderBy("first"))
    return steps.withColumn("place", place).where(F.col("place") <= most).select("group", "src", "kind", "dst", "certainty", "place")


def impact(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """What may be affected by ``changed`` (id): a walk against all edges, whatever their kind."""
    return distances(changed.select("id"), adjacency_of(edges).steps("incoming"), depth)


#: How much each label of evidence holds; ties go by label.
STRENGTH = {"direct": 7, "schema": 6, "certain": 6, "probable": 5, "graph": 4, "heuristic": 3, "uncertain": 2, "bounded": 1}


def strength(label: Column) -> Column:
    return reduce(lambda w, k: w.when(label == k, STRENGTH[k]), STRENGTH, F).otherwise(0)  # type: ignore[arg-type]


def weakest(a: Column, b: Column) -> Column:
    """The label of less strength, of equals the first by name."""
    return F.least(F.struct(strength(a).alias("s"), a.alias("label")), F.struct(strength(b).alias("s"), b.alias("label")))["label"]


def impact_evidence(edges: DataFrame, changed: DataFrame, depth: int) -> DataFrame:
    """(id, distance, confidence, via, edge_id): what a change of ``changed`` (id) reaches against the edges.

    Of the ways that reach a node at its least distance the one with the strongest weakest link
    is told, then that of the first label, then of the least edge.
    """
    label = F.coalesce("certainty", certainty_of(), F.when(F.col("kind").isin(*STRUCTURAL), "certain"), F.lit("graph"))
    steps = adjacency_of(edges).steps("incoming")
    frontier, n = written_rows(changed.select("id").distinct().select("id", F.lit(0).alias("distance"), F.lit("direct").alias("confidence"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("long").alias("edge_id")))
    seen = frontier
    for hop in range(1, depth + 1):
        if not n:
            break
        met = steps.beside(frontier.select(F.col("id").alias("standing"), F.col("confidence").alias("so_far")), n, "standing")
        met = met.select(F.col("next").alias("id"), weakest(F.col("so_far"), label).alias("confidence"), F.col("kind").alias("via"), F.col("id").alias("edge_id"))
        best = F.min(F.struct((-strength(F.col("confidence"))).alias("s"), "confidence", "edge_id", "via")).alias("b")
        fresh = met.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(best)
        frontier, n = written_rows(fresh.select("id", F.lit(hop).alias("distance"), "b.confidence", "b.via", "b.edge_id"))
        seen = seen.unionByName(frontier)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least node that each end of ``edges`` (a, b) is connected with, either way, by labels that spread and jump."""
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("root").alias("near"))
        step = durable(labels.join(near, F.col("id") == F.col("a")).select("id", "root", F.least("root", "near").alias("low")))
        up = step.select(F.col("id").alias("root0"), F.col("low").alias("up"))
        fresh = durable(step.join(up, F.col("low") == F.col("root0"), "left").select("id", F.least("low", F.coalesce("up", "low")).alias("root"), F.col("root").alias("old")))
        if fresh.where("root <> old").isEmpty():
            return fresh.select("id", "root")
        labels = fresh.select("id", "root")
