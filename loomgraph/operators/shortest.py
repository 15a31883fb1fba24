"""The ways from one node to another: distances from both ends under a cap of nodes, one path, and what else lies between.

A walk under a cap meets nodes as a queue would: parents in their order, edges of each by id. What a level finds is put in that order by
the first (parent, edge) that leads to it; a parent is left out once the nodes before it reach the cap. Levels are written. Every
node's best next node is found in one pass over the steps between the two distances; of these pairs, no more than the cap, the driver follows one chain.
Without caps (``whole``) both walks meet all there is; then only nodes on shortest ways get a best next node, of which the driver looks up
one for each step of the path, and only the edges beside the nodes that are kept are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.operators.adjacency import Steps, adjacency_of
from loomgraph.operators.traverse import Trail, _between, distances
from loomgraph.sources.star_schema import Graph
from loomgraph.sources.store import stored, written, written_rows

#: Most nodes that a walk of either end visits, whatever was asked for; fewest edges a node may follow.
MOST_VISITED, FEWEST_EDGES = 100_000, 128
_FAR = 2**31 - 1
_EDGE = ("id", "kind", "src", "dst", "certainty", "confidence")


@dataclass
class Visited:
    """(id, depth, ord) in the order of the walk, and whether a cap cut it."""

    nodes: DataFrame
    truncated: bool


def _first_edges(met: DataFrame, most: int) -> tuple[DataFrame, Observation]:
    """Each node's first ``most`` steps by edge; an action on them observes ``place``, how many the fullest node has."""
    seen = Observation()
    place = F.row_number().over(Window.partitionBy("at").orderBy("id", "next"))
    return met.withColumn("place", place).where(F.col("place") <= most).observe(seen, F.max("place").alias("place")), seen


def capped_distances(start: DataFrame, steps: Steps, depth: int, cap: int, per_node: int, within: DataFrame | None = None) -> Visited:
    """Distances from ``start`` (id), a walk that stops once it has seen ``cap`` nodes; ``depth`` 0 means unlimited.

    A level is one job. It has fewer than ``cap`` parents, each with ``per_node`` edges at most, and what is put in order in one task are
    the first nodes it finds, as many as the cap leaves room for and one parent's more. ``within`` (id, room) as in ``distances``.
    """
    frontier, fresh = written_rows(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("ord")))
    seen, total, hop, truncated = frontier, fresh, 0, False
    earlier = Window.orderBy("parent").rangeBetween(Window.unboundedPreceding, -1)
    while fresh:
        if total >= cap:
            return Visited(seen, True)
        hop += 1
        if hop > depth > 0:
            break
        met = steps.beside(frontier.select(F.col("id").alias("standing"), F.col("ord").alias("parent")), fresh, "standing").select("at", "next", "id", "parent").where("next is not null")
        met, fullest = _first_edges(met, per_node)
        found = met.select(F.col("next").alias("node"), F.struct("parent", F.col("id").alias("edge")).alias("first")).groupBy("node").agg(F.min("first").alias("first"))
        if within is not None:
            found = found.join(within.where(F.col("room") >= hop).select(F.col("id").alias("node")), "node", "left_semi")
        found = found.join(seen.select(F.col("id").alias("node")), "node", "left_anti").select("node", "first.parent", "first.edge")
        near = found.orderBy("parent", "edge", "node").limit(cap - total + per_node)
        kept = near.withColumn("before", F.count(F.lit(1)).over(earlier)).where(F.col("before") + total < cap)
        order = F.row_number().over(Window.orderBy("parent", "edge", "node")).cast("long")
        frontier, fresh = written_rows(kept.select(F.col("node").alias("id"), F.lit(hop).alias("depth"), order.alias("ord")))
        truncated |= (fullest.get["place"] or 0) >= per_node
        seen, total = (seen.unionByName(frontier) if fresh else seen), total + fresh
    return Visited(seen, truncated)


@dataclass
class Ways:
    """What lies between two nodes: the trail, and its one path as (position, id), empty where none leads."""

    trail: Trail
    path: DataFrame


def ways(g: Graph, source: int, target: int, depth: int = 0, max_nodes: int = 500, kinds: list[str] | None = None, node_kinds: list[str] | None = None, tests: bool = True, utility: bool = True, visited: int | None = None, whole: bool = False) -> Ways:
    """Nodes and edges on ways of at most ``depth`` steps (0: any) from source to target.

    The path takes, at each node, the next one that is nearest to the target, of several that of the least
    id. It and the target come first; other nodes by the length of the shortest way through them, then by
    distance from the source and id, as far as ``max_nodes`` allows. Either end's walk visits ``visited`` nodes,
    four times as many as asked for unless given; with ``whole`` all nodes and all their edges. Where no way is found the endpoints alone come back, the target without a depth.
    """
    spark = g.node.sparkSession
    adjacent = adjacency_of(g.edge)
    out, back_steps = (adjacent.steps(d, kinds, tests, utility) for d in ("outgoing", "incoming"))
    cap, per_node = min(visited or 4 * max_nodes, MOST_VISITED), max(3 * max_nodes, FEWEST_EDGES)
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    ahead = Visited(distances(one(source), out, depth), False) if whole else capped_distances(one(source), out, depth, cap, per_node)
    no_edges = spark.createDataFrame([], "id long, kind string, src long, dst long, certainty string, confidence double, ord long")
    if ahead.nodes.where(F.col("id") == target).isEmpty():
        ends = spark.createDataFrame([(source, 0, 0), (target, None, 1)], "id long, depth int, ord int")
        nodes = ends.join(g.node.select("id"), "id", "left_semi")
        return Ways(Trail(nodes, no_edges, ahead.truncated, 0, source), spark.createDataFrame([], "position int, id long"))
    room = F.lit(_FAR) if depth == 0 else F.lit(depth) - F.col("depth")
    within = ahead.nodes.select("id", room.alias("room"))
    behind = Visited(distances(one(target), back_steps, depth, within), False) if whole else capped_distances(one(target), back_steps, depth, cap, per_node, within)
    whole = ahead.nodes.select("id", "depth").join(behind.nodes.select("id", F.col("depth").alias("back")), "id", "left")
    fits = F.lit(True) if depth == 0 else F.col("depth") + F.col("back") <= depth
    included, n_included = written_rows(whole.where((F.col("back").isNotNull() & fits) | F.col("id").isin(source, target)))

    far = included.where("back is not null").select(F.col("id").alias("next"), F.col("depth").alias("next_depth"), "back")
    best = F.min(F.struct("back", "next")).alias("best")
    truncated = ahead.truncated or behind.truncated
    on_path = [source]
    if whole:
        # What leads on from a node of a shortest way to the next of one: no other node is on the path.
        length = included.where(F.col("id") == target).first()["depth"]
        near, n_near = written_rows(included.where(F.col("depth") + F.col("back") == length).select("id", "depth"))
        onward = out.beside(near.select(F.col("id").alias("standing"), F.col("depth").alias("from_depth")), n_near, "standing").select("at", "next", "from_depth").join(far, "next")
        succ = stored(onward.where((F.col("next_depth") == F.col("from_depth") + 1) & (F.col("next_depth") + F.col("back") == length)).groupBy("at").agg(best).select("at", "best.next"), "at")
        while on_path[-1] != target:
            on_path.append(succ.where(F.col("at") == on_path[-1]).first()["next"])
    else:
        met, fullest = _first_edges(out.beside(included.select(F.col("id").alias("standing"), F.col("depth").alias("from_depth")), n_included, "standing"), per_node)
        steps = met.join(far, "next")
        steps = written((steps if depth == 0 else steps.where(F.col("from_depth") + 1 + F.col("back") <= depth)).select("at", "next", "from_depth", "next_depth", "back", *_EDGE))
        truncated = truncated or (fullest.get["place"] or 0) >= per_node
        onward = steps.where((F.col("at") != target) & (F.col("next_depth") == F.col("from_depth") + 1))
        # A row a visited node at most.
        succ = {r["at"]: r["next"] for r in onward.groupBy("at").agg(best).select("at", "best.next").collect()}
        while on_path[-1] in succ:
            on_path.append(succ[on_path[-1]])
    path = spark.createDataFrame(list(enumerate(on_path)), "position int, id long")
    first = list(dict.fromkeys([*on_path, target]))
    listed = included.join(F.broadcast(spark.createDataFrame([(i,) for i in first], "first long")), F.col("id") == F.col("first"), "left")
    order = [F.col("first").isNull(), F.coalesce(F.col("depth") + F.col("back"), F.lit(_FAR)), "depth", "id"]
    selected, n_selected = written_rows(listed.orderBy(*order).limit(max(max_nodes, len(first))).select("id", "depth", "back"))
    nodes = selected.join(g.node.select("id", "kind"), "id", "left_semi" if not node_kinds else "inner")
    if node_kinds:
        nodes = nodes.where(F.col("kind").isin(node_kinds) | F.col("id").isin(source, target))
    # At most as many nodes as were asked for.
    nodes = nodes.select("id", "depth", (F.row_number().over(Window.orderBy("depth", "id")) - 1).alias("ord"))
    ends = selected.select(F.col("id").alias("src"))
    if whole:
        # The edges of the nodes that are kept, as many as were asked for; both ends are among these.
        steps = out.beside(selected.select(F.col("id").alias("standing"), F.col("depth").alias("from_depth")), n_selected, "standing").join(selected.where("back is not null").select(F.col("id").alias("next"), "back"), "next")
        steps = steps if depth == 0 else steps.where(F.col("from_depth") + 1 + F.col("back") <= depth)
    inner = steps.where("at = src").join(ends, "src", "left_semi").join(ends.withColumnRenamed("src", "dst"), "dst", "left_semi")
    kept = written(inner.select(*_EDGE).dropDuplicates(["id", "src", "dst"]).withColumn("ord", F.col("id")))
    edges = written(_between(kept, nodes))
    truncated = truncated or n_included > max_nodes or n_selected < n_included
    return Ways(Trail(nodes, edges, truncated, kept.count() - edges.count(), source), path)
