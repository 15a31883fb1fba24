"""Stored relations: tables written once a session to the folder that driver and executors share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TypeVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one beside the warehouse, which executors share too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomgraph-store").rstrip("/")


_building: list[list[str]] = []


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written to the shared folder, partitioned ``by`` columns, and read back: a cut of the lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/loomgraph/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    for paths in _building:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """As ``written``, and the number of rows, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def stored(df: DataFrame, *sort: str) -> DataFrame:
    """``df`` written and read back, sorted in each file by ``sort``, so that row groups can be skipped by their bounds."""
    return written(df.sortWithinPartitions(*sort) if sort else df)


#: Rows of a file, about; most slots of a table; keys up to which rows are looked up, and up to which keys are broadcast.
FILE_ROWS, MOST_SLOTS, LOOKED_UP, BROADCAST = 1_000_000, 4093, 1_000, 1_000_000


#: Rows that one task sorts or joins, about: more rows are more tasks, not larger ones.
TASK_ROWS = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """How many tasks share ``rows`` rows that are shuffled and sorted."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def _prime(low: int) -> int:
    """The least prime not below ``low``."""
    n = max(2, low)
    while any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


@dataclass
class Slotted:
    """Rows by a key of whole numbers, partitioned by ``slot``, the key modulo a prime; 0 slots where they are not stored."""

    rows: DataFrame
    key: str
    slots: int = 0

    def at(self, keys: list[int]) -> DataFrame:
        """The rows of a few keys: other slots are not read, other keys' rows are skipped by the scan."""
        here = F.col(self.key).isin(keys)
        if self.slots:
            here = F.col("slot").isin(sorted({k % self.slots for k in keys})) & here
        return self.rows.where(here)

    def where(self, condition) -> Slotted:  # noqa: ANN001
        return replace(self, rows=self.rows.where(condition))

    def beside(self, keys: DataFrame, n: int, column: str) -> DataFrame:
        """The rows of the keys in ``column`` with the other columns of ``keys``, of which there are ``n`` rows.

        Few are looked up; more, as long as they are few enough to send, are broadcast; beyond that the join shuffles.
        """
        name = "_standing"
        there = keys.withColumnRenamed(column, name)
        if self.slots and n <= LOOKED_UP:
            few = [r[0] for r in there.select(name).distinct().collect() if r[0] is not None]
            return self.at(few).join(F.broadcast(there), F.col(self.key) == F.col(name)).drop(name)
        return self.rows.join(F.broadcast(there) if n <= BROADCAST else there, F.col(self.key) == F.col(name)).drop(name)


def by_slots(df: DataFrame, key: str, rows: int, slot_rows: int, *sort: str, within: tuple[str, ...] = ()) -> Slotted:
    """``df``, of about ``rows`` rows, stored by slots of about ``slot_rows``, sorted by key and ``sort`` in each file.

    A slot with many rows, as that of a key with a large share of all, is dealt over several files by the columns ``within``,
    so neither writing nor reading it is one task's work.
    """
    slots = _prime(min(MOST_SLOTS, rows // slot_rows + 1))
    own = df.where(F.col(key).isNotNull()).withColumn("slot", F.pmod(key, F.lit(slots)).cast("int"))
    lanes = own.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("lanes"))
    # One row a slot.
    own = own.join(F.broadcast(lanes), "slot").withColumn("lane", F.pmod(F.xxhash64(*(within or (key,))), F.col("lanes"))).drop("lanes")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), tasks_for(df.sparkSession, rows))
    dealt = own.repartition(parts, "slot", "lane").drop("lane").sortWithinPartitions("slot", key, *sort)
    return Slotted(written(dealt, "slot"), key, slots)


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def kept(spark: SparkSession, key: str, build: Callable[[], T]) -> T:
    """What ``build`` makes of written tables, made once in this application for each key and shared folder, and again where its files are gone: an index is built once and asked often."""
    held = spark.sparkContext.__dict__.setdefault("_loomgraph_kept", {})
    at = (key, shared_dir(spark))
    if at in held and all(_there(spark, path) for path in held[at][1]):
        return held[at][0]
    paths: list[str] = []
    _building.append(paths)
    try:
        held[at] = (build(), paths)
    finally:
        _building.pop()
    return held[at][0]
