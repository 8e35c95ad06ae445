"""Tumbling counts, the same on a table and on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly_counts(events: DataFrame, late: str | None = None) -> DataFrame:
    """Events by hour and type; ``late`` sets the watermark of a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if late else rows
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def stream_counts(spark: SparkSession, path: str, schema, out: str, checkpoint: str, late: str = "1 day"):
    """Run over the files of a folder as a stream, as far as there are files, and append closed hours to ``out``."""
    s = hourly_counts(spark.readStream.schema(schema).parquet(path), late)
    q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
