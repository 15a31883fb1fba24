"""The edges by the node that a walk stands at, stored both ways, so that a step reads only what lies beside its frontier.

Each way is a table by slots of the endpoint, sorted by endpoint and edge within its files. Endpoints are the effective
ones, after unsure resolutions were set aside. What the walks' filters need of names and paths is stored as two marks. A small frontier is looked up: its slots prune partitions and its
ids are pushed to the scan. A larger one, as long as its checked size allows, is broadcast to the edges; beyond that the join shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.graph import common_call
from loomgraph.functions.paths import in_production
from loomgraph.operators.relational import neutralised
from loomgraph.sources.store import Slotted, by_slots, kept

#: Edges of a slot, about.
SLOT_ROWS = 50_000
_EDGE = ("id", "kind", "certainty", "confidence")


def _ends(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at, next, the edge, whether it calls a common name, whether its caller is in production) outgoing and incoming."""
    e = neutralised(edges)
    for c in (*_EDGE, "target_name", "caller_path"):
        if c not in e.columns:
            e = e.withColumn(c, F.lit(None).cast("double" if c == "confidence" else "long" if c == "id" else "string"))
    own = [*[F.col(c) for c in _EDGE], ((F.col("kind") == "CALL") & common_call(F.coalesce("target_name", F.lit("")))).alias("common"), in_production(F.col("caller_path")).alias("production")]
    return e.select(F.col("src").alias("at"), F.col("dst").alias("next"), *own), e.select(F.col("dst").alias("at"), F.col("src").alias("next"), *own)


def _directed(sides: list[Slotted]) -> list[Slotted]:
    """The outgoing and the incoming side with ``src`` and ``dst``, which are their two ends."""
    ends = (("at", "next"), ("next", "at"))
    return [replace(side, rows=side.rows.withColumns({"src": F.col(a), "dst": F.col(b)})) for side, (a, b) in zip(sides, ends)]


@dataclass
class Adjacency:
    """(at, next, edge's columns) for both directions, by ``at``."""

    outgoing: Slotted
    incoming: Slotted

    def steps(self, direction: str, kinds: list[str] | None = None, tests: bool = True, utility: bool = True) -> Steps:
        """What a walk in this direction may take, after all filters."""
        keep: list[Column] = []
        if not utility:
            keep.append(~F.col("common"))
        if not tests:
            keep.append(F.col("production"))
        if kinds:
            keep.append(F.col("kind").isin(kinds))
        # A self edge is met once in a walk both ways.
        sides = {"outgoing": [self.outgoing], "incoming": [self.incoming], "both": [self.outgoing, self.incoming.where(F.col("at") != F.col("next"))]}[direction]
        for c in keep:
            sides = [side.where(c) for side in sides]
        return Steps(sides)


@dataclass
class Steps:
    """The steps of a walk: (at, next, ...) on one or two sides."""

    sides: list[Slotted]

    def at(self, ids: list[int]) -> DataFrame:
        return reduce(DataFrame.unionByName, [side.at(ids) for side in self.sides])

    def beside(self, frontier: DataFrame, rows: int, column: str = "id") -> DataFrame:
        """``frontier`` with the steps from its nodes; ``rows`` is how many it has."""
        return reduce(DataFrame.unionByName, [side.beside(frontier, rows, column) for side in self.sides])


def plain_steps(steps: DataFrame) -> Steps:
    """Steps that are not stored, from (a, b)."""
    return Steps([Slotted(steps.select(F.col("a").alias("at"), F.col("b").alias("next")), "at")])


def adjacency_of(edges: DataFrame) -> Adjacency:
    """The adjacency of these edges: stored on first use where they are a stored graph's own, else part of the plan."""
    key = getattr(edges, "_loomgraph_adjacency", None)
    if key is None:
        return Adjacency(*_directed([Slotted(side, "at") for side in _ends(edges)]))

    def build() -> Adjacency:
        rows = edges.count()  # from the files' footers
        return Adjacency(*_directed([by_slots(side, "at", rows, SLOT_ROWS, "id", within=("id", "next")) for side in _ends(edges)]))

    return kept(edges.sparkSession, key, build)
