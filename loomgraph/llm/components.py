"""Connected components of a distributed edge list by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node it is linked with.

    Each round takes every node's least neighbouring root and then the root's own root; labels are
    written to the shared folder after each, so a lost executor costs one round at most. The
    number of rounds is logarithmic for stars and chains alike. Nodes without edges are not given.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = cut(both.union(both.select("v", "u")).where("u is not null and v is not null").distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")))
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("root").alias("near"))
        hooked = labels.join(near, labels["node"] == near["u"]).select("node", "root", F.least("root", "near").alias("low"))
        # A root learns the least label that any of its members saw; then every node takes its root's root.
        raised = cut(hooked.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("root_low")))
        step = cut(hooked.join(raised, hooked["root"] == raised["r"]).select("node", F.col("root").alias("old"), F.least("low", "root_low").alias("root")))
        up = step.select(F.col("node").alias("n2"), F.col("root").alias("up"))
        before, labels = labels, cut(step.join(up, step["root"] == up["n2"], "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        release(before, raised, step)
        changed = labels.where("root <> old").limit(1).count()
        if not changed:
            release(both)
            return labels.drop("old")
