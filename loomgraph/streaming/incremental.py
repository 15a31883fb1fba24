"""Incremental maintenance: refresh plans, last-write-wins upserts, and windowed rollups of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh_plan(inventory: DataFrame, stored: DataFrame, complete: bool = True) -> DataFrame:
    """(path, action): ``index`` for new, changed or unindexed files and those to be tried again, ``remove`` for missing ones if the inventory is complete.

    Both frames have path, modified and hash; ``stored`` also indexed, and may have retry. A known hash
    decides over a changed time only where both are known and equal times differ in hash.
    """
    i = inventory.select("path", F.col("modified").alias("m1"), F.col("hash").alias("h1"), F.lit(True).alias("here"))
    retry = F.coalesce("retry", F.lit(False)) if "retry" in stored.columns else F.lit(False)
    s = stored.select("path", F.col("modified").alias("m2"), F.col("hash").alias("h2"), "indexed", retry.alias("retry"), F.lit(True).alias("known"))
    stale = F.col("known").isNull() | ~F.col("indexed") | F.col("retry") | ~F.col("m1").eqNullSafe(F.col("m2")) | (F.col("h2").isNotNull() & ~F.col("h1").eqNullSafe(F.col("h2")))
    action = F.when(F.col("here").isNull(), F.lit("remove" if complete else None)).when(stale, "index")
    return i.join(s, "path", "full").select("path", action.alias("action")).where("action is not null")


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """Last write wins by ``key``: the greatest ``order`` of both frames, of equal ones the greatest row; combined before the shuffle."""
    rest = [c for c in current.columns if c not in (key, order)]
    last = current.unionByName(batch).groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r"))
    return last.select(key, "_r.*").select(*current.columns)


def event_rollup(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and event type; works on a stream (with a watermark) and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events files of a folder as a stream."""
    shape = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(shape).option("pathGlobFilter", "events.parquet").parquet(folder)
