"""Joins: kinds are Spark's to plan, and theta joins are rewritten to equi joins that can be shuffled."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def outer_fold(frames: Sequence[DataFrame], keys: Sequence[str], how: str = "full", fill: float | None = 0.0) -> DataFrame:
    """Several tables on the same keys side by side."""
    out = functools.reduce(lambda a, b: a.join(b, list(keys), how), frames)
    return out if fill is None else out.fillna(fill, [c for c in out.columns if c not in keys])


def wide_by_sample(df: DataFrame, keys: Sequence[str], sample: str, value: str, samples: Sequence[str], share: float) -> DataFrame:
    """One column for each sample, of the keys that more than ``share`` of the samples have."""
    rows = df.where(F.col(sample).isin(list(samples)))
    enough = rows.groupBy(*keys).agg(F.count_distinct(sample).alias("n")).where(F.col("n") > share * len(samples)).select(*keys)
    return rows.join(enough, list(keys), "left_semi").groupBy(*keys).pivot(sample, list(samples)).agg(F.first(value))


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of tables without repeated keys; raises where a key repeats."""
    for side in (a, b):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated keys in {list(keys)}")
    return a.join(b, list(keys))


def array_containment(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_arrays: Sequence[str], right_id: str) -> DataFrame:
    """Left join of rows whose keys are members of the right row's arrays, each pair once.

    ON array_contains(...) would be a nested loop; the arrays are exploded to an equi join instead, after their own repeats are taken out.
    """
    names = [f"__k{i}" for i in range(len(left_keys))]
    keys = right
    for n, a in zip(names, right_arrays, strict=True):
        keys = keys.withColumn(n, F.explode(F.array_distinct(a)))
        if n != names[-1]:
            keys = keys.repartition(n)  # few rows with long arrays are few tasks: the next explode starts from this one's rows
    on = functools.reduce(Column.__and__, [left[k] == keys[n] for k, n in zip(left_keys, names, strict=True)])
    return left.join(keys.hint("merge"), on, "left").drop(*names)  # how many keys the arrays hold isn't known to Spark, which would broadcast them all


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], at_least: int = 1, width: int = 1 << 14, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of half-open intervals of equal keys that share ``at_least`` places; columns of a, then b with the suffix _b.

    Both sides are cut into bins of ``width``, so the join is on equal (keys, bin); a pair is kept only in the bin where its overlap begins, so none
    comes twice.
    """
    bins = lambda d: d.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    right = bins(b.where(F.col(end) > F.col(start))).select(*[F.col(c).alias(c if c in keys or c == "__bin" else f"{c}_b") for c in [*b.columns, "__bin"]])
    both = bins(a.where(F.col(end) > F.col(start))).join(right, [*keys, "__bin"])
    lo, hi = F.greatest(start, f"{start}_b"), F.least(end, f"{end}_b")
    return both.where((hi - lo >= at_least) & (F.floor(lo / width) == F.col("__bin"))).drop("__bin")


def antisense_ids(genes: DataFrame, at_least: int = 1) -> DataFrame:
    """Ids, versions cut off, of genes (id, chrom, start, end, strand) that overlap one of the other strand."""
    pair = overlaps(genes.where("strand = '+'"), genes.where("strand = '-'"), ["chrom"], at_least)
    return pair.select(F.explode(F.array("id", "id_b")).alias("id")).select(F.regexp_replace("id", r"\..*$", "").alias("id")).distinct()


def aligned(keys: DataFrame, values: DataFrame, on: str, fill: float | None = 0.0) -> DataFrame:
    """Every key, with its values or ``fill``; None raises where one is missing."""
    out = keys.join(values, on, "left")
    rest = [c for c in values.columns if c != on]
    if fill is None:
        if not out.where(functools.reduce(Column.__or__, [F.col(c).isNull() for c in rest])).isEmpty():
            raise ValueError("keys without values")
        return out
    return out.fillna(fill, rest)


def bridged(df: DataFrame, bridge: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose key is in the bridge; if none is, keys are tried without a leading X."""
    hit = df.join(bridge, on, "left_semi")
    return hit if not hit.isEmpty() else df.withColumn(on, F.regexp_replace(on, "^X", "")).join(bridge, on, "left_semi")


def two_conditions(a: DataFrame, b: DataFrame, key: str, value: str, needs: str | None = None) -> DataFrame:
    """Full outer comparison of one value: nulls as 0, difference, sign change; largest absolute difference first."""
    both = a.select(key, F.col(value).alias("v1"), *([needs] if needs else [])).join(b.select(key, F.col(value).alias("v2")), key, "full")
    if needs:
        both = both.where(F.col(needs).isNotNull())
    both = both.fillna(0.0, ["v1", "v2"])
    return both.withColumns({"exchange_sign": F.col("v1") * F.col("v2") < 0, "diff": F.col("v2") - F.col("v1"), "abs_diff": F.abs(F.col("v2") - F.col("v1"))}).orderBy(F.desc("abs_diff"), key)


def resolved_aliases(names: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """names with symbol: their own if they are symbols, else the one symbol of their alias; aliases of several symbols resolve to none.

    aliases: (alias, symbol). A target claimed by two source names is contested, and neither gets it.
    """
    known = aliases.select("symbol").distinct().withColumn("own", F.lit(True))
    single = aliases.select(F.upper("alias").alias("u"), "symbol").distinct().groupBy("u").agg(F.min("symbol").alias("target"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = names.join(known, names[name] == known["symbol"], "left").drop("symbol").withColumn("u", F.upper(name)).join(single, "u", "left")
    out = out.withColumn("symbol", F.when(F.col("own"), F.col(name)).otherwise(F.col("target")))
    n = F.size(F.collect_set(name).over(Window.partitionBy("symbol")))
    return out.withColumn("symbol", F.when(n == 1, F.col("symbol")).otherwise(F.when(F.col("own"), F.col("symbol")))).drop("own", "u", "target")


def membership_flag(df: DataFrame, others: DataFrame, on: str, flag: str) -> DataFrame:
    return df.join(others.select(on).distinct().withColumn(flag, F.lit(True)), on, "left").fillna(False, [flag])


def pairs(df: DataFrame, id_col: str) -> DataFrame:
    """All pairs of ids, a before b, of a small dimension."""
    a, b = df.select(F.col(id_col).alias("a")), df.select(F.col(id_col).alias("b"))
    return a.join(b, F.col("a") < F.col("b"))


def covering_shards(values: DataFrame, index: DataFrame, value: str = "value") -> DataFrame:
    """Rows (shard) of an index (shard, lo, hi) whose range holds one of the values, by a search in their common order."""
    from larkspan.sources.atlas import covering

    return covering(index.select("shard", "lo", "hi"), values, value).select("shard")
