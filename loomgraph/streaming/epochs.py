"""Epochs of path changes: a stream of numbered changes is cut in epochs, and each is sealed as proven or not.

An epoch whose changes follow each other and the epoch before without a gap, none of them told as lost, names
all that changed: files to read again, and folders whose members changed. Of any other epoch nothing can be concluded but
that everything must be looked at, so its work is the whole inventory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.sources.publish import Publisher

#: Folders whose changes never count.
IGNORED = r"(^|/)(\.git|target|node_modules)(/|$)"
MUTATED, MEMBERSHIP, LOST = "mutated", "membership", "lost"


def sealed(changes: DataFrame, last: int | None) -> DataFrame:
    """(epoch, armed, sealed, proven, gap, dirty, rescan): one row an epoch of changes (epoch, seq, path, kind).

    ``last`` is the number sealed before the first epoch, null where nothing was, so that it may start anywhere. A change
    that comes twice counts once; one without a number is as good as lost. Of rows an epoch only totals leave their task, so ordering the epochs is small.
    """
    own = changes.dropDuplicates(["epoch", "seq", "path", "kind"])
    counts = F.coalesce("path", F.lit("")).rlike(IGNORED)
    per = own.groupBy("epoch").agg(
        F.min("seq").alias("first"), F.max("seq").alias("sealed"), F.count_distinct("seq").alias("n"), F.max(((F.col("kind") == LOST) | F.col("seq").isNull()).cast("int")).alias("lost"),
        F.count_distinct(F.when((F.col("kind") == MUTATED) & ~counts, F.col("path"))).alias("dirty"), F.count_distinct(F.when((F.col("kind") == MEMBERSHIP) & ~counts, folder())).alias("rescan"),
    )
    before = F.coalesce(F.last("sealed", ignorenulls=True).over(Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(last).cast("long"))
    armed = F.coalesce(before, F.col("first") - 1)
    gap = F.when(F.col("lost") == 1, "coverage_lost").when(F.col("first") != armed + 1, "missing_before").when(F.col("n") != F.col("sealed") - F.col("first") + 1, "missing_within")
    return per.select("epoch", armed.alias("armed"), F.coalesce("sealed", before).alias("sealed"), gap.isNull().alias("proven"), gap.alias("gap"), "dirty", "rescan")


def folder(path: str = "path"):  # noqa: ANN201
    """The folder of a path, empty at the top."""
    return F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def worklist(changes: DataFrame, epochs: DataFrame, inventory: DataFrame) -> DataFrame:
    """(epoch, path, action): of proven epochs ``rehash`` files and ``rescan`` folders, of others ``full``, every path of the inventory (path)."""
    known = epochs.select("epoch", "proven")
    c = changes.join(known.where("proven"), "epoch").where(~F.coalesce("path", F.lit("")).rlike(IGNORED))
    rehash = c.where(F.col("kind") == MUTATED).select("epoch", "path", F.lit("rehash").alias("action"))
    rescan = c.where(F.col("kind") == MEMBERSHIP).select("epoch", folder().alias("path"), F.lit("rescan").alias("action"))
    lost = [r["epoch"] for r in known.where("not proven").select("epoch").collect()]  # a row an epoch
    full = inventory.select(F.explode(F.array(*[F.lit(x).cast("long") for x in lost])).alias("epoch"), "path", F.lit("full").alias("action")) if lost else rehash.limit(0)
    return rehash.unionByName(rescan).distinct().unionByName(full)


def seal_batches(stream: DataFrame, publisher: Publisher, inventory: DataFrame, checkpoint: str):  # noqa: ANN201
    """A query that seals each micro-batch of (seq, path, kind) as an epoch and publishes it with its work.

    The number sealed last is a mark of the published generation, as is the batch's; a batch that runs again is sealed once.
    """

    def seal(batch: DataFrame, number: int) -> None:
        publisher.recover()
        marks = publisher.marks()
        if marks.get("epoch", -1) >= number:
            return
        changes = batch.select(F.lit(number).cast("long").alias("epoch"), "seq", "path", "kind").persist()
        try:
            epochs = sealed(changes, marks.get("sealed"))
            row = epochs.first()
            if row is None:
                return
            staged = publisher.stage({}, {"epoch": epochs, "work": worklist(changes, epochs, inventory)}, publisher.live(), {"epoch": number, "sealed": max((x for x in (row.sealed, marks.get("sealed")) if x is not None), default=None)})
            publisher.promote(staged)
        finally:
            changes.unpersist()

    return stream.writeStream.foreachBatch(seal).option("checkpointLocation", checkpoint)
