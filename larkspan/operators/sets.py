"""Set operations."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    return union_all(frames).distinct()


def union_all(frames: Sequence[DataFrame], tags: Sequence[str] | None = None, tag: str = "source") -> DataFrame:
    """Rows of all tables by column name, columns that one lacks as nulls; each marked with its tag if tags are given."""
    rows = [f.withColumn(tag, F.lit(t)) for f, t in zip(frames, tags, strict=True)] if tags else list(frames)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def common(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys in every table, in one aggregation."""
    tagged = union_all([f.select(key).distinct() for f in frames])
    return tagged.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") == len(frames)).select(key)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``old`` whose whole key is not in ``new``, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
