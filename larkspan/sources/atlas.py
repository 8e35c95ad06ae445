"""Large sharded Parquet tables: an index of file footers, pruning by it, scans that go on where they were stopped, and the pivot of what was asked for."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from hashlib import sha1

import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspan.operators.lineage import Steps

INDEX = "shard string, size long, modified long, n_rows long, n_groups int, lo string, hi string, known boolean"


def _fs(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def shard_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (shard, size, modified) of the Parquet files below a folder: names and sizes only."""
    fs, where = _fs(spark, root)
    it, rows = fs.listFiles(where, True), []
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()
        if name.endswith(".parquet") and not f.getPath().getName().startswith(("_", ".")):
            rows.append((name, f.getLen(), f.getModificationTime()))
    return spark.createDataFrame(rows, "shard string, size long, modified long")


def shard_sizes(files: DataFrame) -> DataFrame:
    """Number of files, their bytes in all, the least, the median and the largest."""
    return files.agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"), F.min("size").alias("least"), F.median("size").alias("median"), F.max("size").alias("largest"))


def footers(files: DataFrame, column: str, per_task: int = 64) -> DataFrame:
    """Rows of INDEX: a column's least and greatest value of each file, read from the footers by the executors; no data page is touched.

    lo and hi are strings that cast back to the column's type. Where a row group has no statistics, or the file can't be opened but by Spark, known is false and lo, hi are null: such a file is always read. A file of no rows or nulls alone is
    known and has nulls.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            rows = []
            for shard, size, modified in zip(g["shard"], g["size"], g["modified"], strict=True):
                try:
                    fs, path = pyarrow.fs.FileSystem.from_uri(shard)
                    with fs.open_input_file(path) as f:
                        meta = pq.ParquetFile(f).metadata
                except (OSError, ValueError, NotImplementedError):
                    rows.append((shard, size, modified, None, None, None, None, False))
                    continue
                place = next((i for i in range(meta.num_columns) if meta.schema.column(i).path == column), None)
                if place is None:
                    raise ValueError(f"{shard} has no column {column}")
                lo = hi = None
                known = True
                for k in range(meta.num_row_groups):
                    group = meta.row_group(k)
                    s = group.column(place).statistics
                    if s is None or not s.has_min_max:
                        known &= s is not None and s.has_null_count and s.null_count == group.num_rows
                        continue
                    lo, hi = (s.min if lo is None else min(lo, s.min)), (s.max if hi is None else max(hi, s.max))
                text = lambda v: None if v is None else v.decode() if isinstance(v, bytes) else str(v)
                rows.append((shard, size, modified, meta.num_rows, meta.num_row_groups, text(lo) if known else None, text(hi) if known else None, known))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])

    tasks = max(1, -(-files.count() // per_task))
    return files.repartition(tasks).mapInPandas(run, INDEX)


def footer_index(spark: SparkSession, root: str, column: str, at: str) -> DataFrame:
    """The index of a folder's files, kept at ``at`` and added to: only files that are new or have another size or time are opened. Entries of files that are gone or have changed stay in the store and out of the result."""
    files = shard_files(spark, root)
    key = ["shard", "size", "modified"]
    store = f"{at.rstrip('/')}/{column}"
    fs, where = _fs(spark, store)
    have = spark.read.schema(INDEX).parquet(store) if fs.exists(where) else None
    new = files if have is None else files.join(have.select(*key), key, "left_anti")
    footers(new, column).write.mode("append").parquet(store)
    return spark.read.schema(INDEX).parquet(store).join(files, key, "left_semi").dropDuplicates(["shard"])


def covering(index: DataFrame, values: DataFrame, value: str = "value", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """The rows of ``index`` whose range from lo to hi holds one of the values; a row with a null end holds none.

    A range holds a value if the least value from lo on isn't above hi. Values and range starts are range-partitioned together and sorted, so each part finds that value by one running minimum, or takes the first value of the parts
    after it: no nested loop, nothing broadcast but one row for each part.
    """
    kind = dict(index.dtypes)[lo]
    steps = Steps(index.sparkSession)
    ends = index.where(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    starts = ends.select(F.col(lo).alias("__key"), F.lit(1).alias("__kind"), F.struct(*index.columns).alias("__row"))
    points = values.where(F.col(value).isNotNull()).select(F.col(value).cast(kind).alias("__key")).distinct().select("__key", F.lit(0).alias("__kind"), F.lit(None).cast(starts.schema["__row"].dataType).alias("__row"))
    rows = steps.write(starts.union(points).repartitionByRange("__key").withColumn("__part", F.spark_partition_id()))
    after = Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)
    later = rows.groupBy("__part").agg(F.min(F.when(F.col("__kind") == 0, F.col("__key"))).alias("m")).select("__part", F.min("m").over(after).alias("__later"))
    down = Window.partitionBy("__part").orderBy(F.desc("__key"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("__next", F.min(F.when(F.col("__kind") == 0, F.col("__key"))).over(down)).where("__kind = 1").join(F.broadcast(later), "__part")
    return found.where(F.coalesce("__next", "__later") <= F.col(f"__row.{hi}")).select("__row.*")


def shards_for(index: DataFrame, values: DataFrame, kind: str, value: str = "value") -> DataFrame:
    """Rows (shard) of a footer index that can hold one of the values of type ``kind``; files without known ends are among them."""
    typed = index.where("known").select("shard", F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi"))
    return covering(typed, values, value).select("shard").union(index.where("not known").select("shard"))


def scan(spark: SparkSession, shards: Sequence[str], out: str, rows: Callable[[DataFrame], DataFrame], batch: int = 32) -> DataFrame:
    """``rows`` of each shard's table, written below ``out`` and read back: rows (shard, state, error) tell what became of each shard: done, before (by an earlier run), or failed.

    Shards go in batches, each a Spark job of its own that writes one folder named after its shards and the plan of what is asked of them; a folder that was written to its end isn't written again, so a run that was stopped goes on where it was. A batch that
    fails is tried once more shard by shard, and the shards that fail again are told and left out.
    """
    told = []

    def write(group: list[str]) -> str:
        name = f"{out.rstrip('/')}/part={sha1(chr(10).join(group).encode()).hexdigest()[:16]}"
        fs, where = _fs(spark, name)
        if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where, "_SUCCESS")):
            return "before"
        rows(spark.read.parquet(*group)).write.mode("overwrite").parquet(name)
        return "done"

    ordered = sorted(shards)
    for i in range(0, len(ordered), batch):
        group = ordered[i : i + batch]
        try:
            state = write(group)
            told += [(s, state, None) for s in group]
        except Exception:  # noqa: BLE001  whatever a job ends with; each shard of it is tried alone and told
            for s in group:
                try:
                    told.append((s, write([s]), None))
                except Exception as e:  # noqa: BLE001
                    told.append((s, "failed", str(e).splitlines()[0][:300]))
    return spark.createDataFrame(told, "shard string, state string, error string")


def scanned(spark: SparkSession, out: str) -> DataFrame:
    """All that scan() has written below ``out``."""
    return spark.read.parquet(out).drop("part")


def pivoted(df: DataFrame, key: str, condition: str, value: str, conditions: Sequence) -> DataFrame:
    """Mean value by key, one column for each of the conditions asked for; means are of rows, so partial means of shards never meet."""
    return df.groupBy(key).pivot(condition, list(conditions)).agg(F.avg(value))


def atlas(spark: SparkSession, root: str, index_at: str, column: str, values: DataFrame, kind: str, keep: Column, key: str, condition: str, value: str, conditions: Sequence, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pivot, report): the rows of a sharded table that have one of the values and pass ``keep``, as means by key and condition; and one row (n_files, n_read, n_failed).

    Files are found by their footers, and only columns of use are read; the filter goes to the scan as well, so row groups are pruned too. Raises if no file of those needed could be read.
    """
    index = footer_index(spark, root, column, index_at)
    names = [r[0] for r in shards_for(index, values.select(F.col(values.columns[0]).alias("value")), kind).collect()]  # a name for each file
    total = index.count()
    out = out or f"{Steps(spark).path}/{uuid.uuid4().hex}"
    if not names:
        empty = spark.read.parquet(root).limit(0)
        return pivoted(empty, key, condition, value, conditions), spark.createDataFrame([(total, 0, 0)], "n_files int, n_read int, n_failed int")
    wanted = values.select(F.col(values.columns[0]).alias(column)).distinct()
    told = scan(spark, names, out, lambda df: df.where(keep).join(wanted, column, "left_semi").select(key, condition, F.col(value).cast("double").alias(value)))
    failed = told.where("state = 'failed'").count()
    if failed == len(names):
        raise OSError(told.first().error)
    return pivoted(scanned(spark, out), key, condition, value, conditions), spark.createDataFrame([(total, len(names) - failed, failed)], "n_files int, n_read int, n_failed int")
