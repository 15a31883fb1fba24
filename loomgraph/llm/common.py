"""What the operators of this subpackage share: tables in the shared folder, row sources, checks."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a folder of the warehouse, which they share too.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/loomgraph-cuts"
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Shuffle files go when the execution that made them ends; what it wrote is in the shared folder by then.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _lean(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph/{uuid.uuid4().hex}"
    with _lean(spark):
        df.write.parquet(path)
    return _noted(spark.read.schema(df.schema).parquet(path), path, None)


_recorders: list[list[DataFrame]] = []


def _noted(table: DataFrame, path: str, name: str | None) -> DataFrame:
    table._loomgraph_cut = (path, name)  # type: ignore[attr-defined]
    for tables in _recorders:
        tables.append(table)
    return table


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables cut meanwhile, for a caller who knows when they are no longer read."""
    tables: list[DataFrame] = []
    _recorders.append(tables)
    try:
        yield tables
    finally:
        _recorders.pop()


def cut_bucketed(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """As ``cut``, kept in hash buckets of ``keys``: later joins on them leave these rows where they are."""
    spark = df.sparkSession
    name = f"loomgraph_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/loomgraph/{name}"
    with _lean(spark):
        df.write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return _noted(spark.table(name), path, name)


def release(*tables: DataFrame | None) -> None:
    """Delete the files of cut tables that nothing will read again; other frames are left alone."""
    for table in tables:
        path, name = getattr(table, "_loomgraph_cut", (None, None)) if table is not None else (None, None)
        if path is None:
            continue
        spark = table.sparkSession
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, run: Callable[[_Batches], _Batches], shape: str | T.StructType) -> DataFrame:
    """``df`` mapped by ``run`` in bounded memory, whatever the length of its texts.

    Batches have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes (smaller settings of the
    session, and sizes given with a unit, stay), and a worker gives freed memory back when a task ends: it outlives the stage.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))

    def lean(batches: _Batches) -> _Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:
            pass  # not in this C library; what is freed then stays with the worker

    return df.mapInArrow(lean, shape)


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, so that an operator's own columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def unfolded(df: DataFrame, row: str, columns: list[str], changed: dict[str, Column]) -> DataFrame:
    """The struct ``row`` as columns again, those in ``changed`` replaced."""
    return df.select(*[(changed[c] if c in changed else F.col(row).getField(c)).alias(c) for c in columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


WORD = r"[^\x20\x09-\x0D]+"
