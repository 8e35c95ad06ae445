"""Shared folders, cut lineage and session facts for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends in order.

    Where the setting is missing, a local master gets a folder of its own (as in tests); a cluster gets an error,
    for a folder of one machine would be wrong there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "/tmp/checkpoints"
    path = f"{root.rstrip('/')}/larkspan/{uuid.uuid4().hex}"
    fs, where = _folder(spark, path)
    fs.deleteOnExit(where)
    return path


_SCOPES: list[dict[str, bool]] = []


def _folder(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Within it, what cut() writes is deleted at the end, but for what is cut by the function that it gives: results that are made of other cut tables are made in here."""
    made: dict[str, bool] = {}
    _SCOPES.append(made)

    def kept(df: DataFrame) -> DataFrame:
        before = set(made)
        out = cut(df)
        for path in set(made) - before:
            made[path] = True
        return out

    try:
        yield kept
    finally:
        _SCOPES.pop()
        for path, stays in made.items():
            if not stays:
                fs, where = _folder(spark, path)
                fs.delete(where, True)
            elif _SCOPES:
                _SCOPES[-1][path] = False  # the outer scope decides


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it back: its lineage ends there, and a lost executor costs no rerun.

    The driver's collection of garbage lets Spark's cleaner delete the shuffle files that only the finished job needed.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if _SCOPES:
        _SCOPES[-1][path] = False
    small_batches(spark)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once: Arrow batches of BATCH_BYTES, if the session would make larger ones."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


_REMEMBERED: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a worker keeps between its tasks, made where it is missing. Workers go on to other operators' tasks, and tidy() ones forget it."""
    if name not in _REMEMBERED:
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def forget() -> None:
    _REMEMBERED.clear()


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a task of mapInArrow, after which its worker gives the freed memory back: idle workers stay beside the next stages' tasks. What other operators' tasks have left remembered goes first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return task


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """``df`` sorted by ``order``, with __rank (from 0, gapless) and __all (row count), and its lineage cut.

    Rows are range-partitioned and sorted; a row's rank is its place in its partition plus the counts of the partitions before. Only one row
    for each partition goes through the single-task window and the broadcast.
    """
    rows = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = cut(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    return rows.join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")
