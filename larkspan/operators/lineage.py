"""Written state for iterative operators: each step's rows go to Parquet in the shared folder, so a lost executor costs no rerun and plans don't grow from step to step."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Steps:
    """A folder for the steps of one run under spark.checkpoint.dir, deleted when the driver's JVM ends in order. Where the setting is missing a local master gets a folder of its own, a cluster an error."""

    def __init__(self, spark: SparkSession):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.gettempdir()
        self.spark, self.path, self.n = spark, f"{root.rstrip('/')}/larkspan/{uuid.uuid4().hex}", 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.deleteOnExit(where)

    def write(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """``df`` as written: under a name, rows are added to those written under it before, and all of them come back."""
        self.n += 1
        path = f"{self.path}/{name or f'step{self.n}'}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete what an unnamed step has written, if it isn't read any more."""
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f), True)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 1 in that order: range-partitioned, sorted and written, so a row's number is its place in its part plus the counts of the parts before; the only window over all has one row for each part."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = Steps(df.sparkSession).write(rows.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__at")))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")
