"""Filters: predicates are pushed to the scan where they are plain; group conditions are one aggregation and a semi join."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def degs(df: DataFrame, lfc_cut: float, fdr_cut: float, lfc: str = "lfc", fdr: str = "fdr") -> DataFrame:
    """Rows with |lfc| at or above its cut and fdr strictly below its own."""
    return df.where((F.abs(F.col(lfc)) >= lfc_cut) & (F.col(fdr) < fdr_cut))


def up_down(df: DataFrame, lfc: str = "lfc") -> DataFrame:
    return df.withColumn("direction", F.when(F.col(lfc) > 0, "up").when(F.col(lfc) < 0, "down"))


def significant_pathways(df: DataFrame, pval: float, fdr: float, genes: int) -> DataFrame:
    return df.where((F.col("pval") < pval) & (F.col("fdr") < fdr) & (F.col("num_of_genes") >= genes))


def threshold_counts(df: DataFrame, keys: Sequence[str], lfc: str, fdr: str, lfc_cuts: Sequence[float], fdr_cuts: Sequence[float]) -> DataFrame:
    """Rows that pass each pair of thresholds, by keys, with those above and below zero.

    The grid is a literal array exploded after one aggregation to distinct values would not help, so each row is compared with the few thresholds in place and
    partial counts are what is shuffled.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("lfc_cut"), F.lit(float(b)).alias("fdr_cut")) for a in lfc_cuts for b in fdr_cuts])).alias("g")
    passed = (F.abs(F.col(lfc)) >= F.col("g.lfc_cut")) & (F.col(fdr) < F.col("g.fdr_cut"))
    rows = df.select(*keys, lfc, fdr, grid)
    return rows.groupBy(*keys, F.col("g.lfc_cut").alias("lfc_cut"), F.col("g.fdr_cut").alias("fdr_cut")).agg(F.count_if(passed).alias("n"), F.count_if(passed & (F.col(lfc) > 0)).alias("n_up"), F.count_if(passed & (F.col(lfc) < 0)).alias("n_dw"))


def contains_ci(c: str, term: str, negate: bool = False) -> Column:
    """Case-insensitive substring test; a null never matches, and passes a negated test."""
    hit = F.coalesce(F.lower(F.col(c)).contains(term.lower()), F.lit(False))
    return ~hit if negate else hit


def any_rlike(columns: Sequence[str], pattern: str) -> Column:
    """Regular expression over several nullable columns."""
    return functools.reduce(Column.__or__, [F.coalesce(F.col(c), F.lit("")).rlike(f"(?i){pattern}") for c in columns])


def members(df: DataFrame, others: DataFrame, on: Sequence[str], negate: bool = False) -> DataFrame:
    """Rows whose key is (not) in another table; Spark plans the semi join."""
    return df.join(others.select(*on).distinct(), list(on), "left_anti" if negate else "left_semi")


def without_pattern(df: DataFrame, c: str, pattern: str) -> DataFrame:
    return df.where(~F.coalesce(F.col(c).rlike(f"^(?:{pattern})"), F.lit(False)))


def flagged_ids(df: DataFrame, id_col: str, condition: Column, prefix: str = "N-") -> DataFrame:
    return df.withColumn(id_col, F.when(F.coalesce(condition, F.lit(False)), F.concat(F.lit(prefix), F.col(id_col).cast("string"))).otherwise(F.col(id_col).cast("string")))


def expressed(df: DataFrame, gene: str, value: str, at_least: float, share: float, forced: DataFrame | None = None) -> DataFrame:
    """Genes with ``value`` at or above ``at_least`` in ``share`` of their rows, and the forced ones."""
    fit = df.groupBy(gene).agg(F.avg((F.col(value) >= at_least).cast("double")).alias("s")).where(F.col("s") >= share).select(gene)
    return df.join(fit if forced is None else fit.union(forced.select(gene)).distinct(), gene, "left_semi")


def filter_sweep(df: DataFrame, gene: str, share: str, count: str, shares: Sequence[float], counts: Sequence[float], in_share: float = 0.5) -> DataFrame:
    """Genes that survive each pair of thresholds: median of ``count`` and the part of rows with ``share`` at or above one."""
    grid = [(a, b) for a in shares for b in counts]
    per = df.groupBy(gene).agg(F.median(count).alias("med"), *[F.avg((F.col(share) >= a).cast("double")).alias(f"s{i}") for i, a in enumerate(shares)])
    made = [F.count_if((F.col(f"s{list(shares).index(a)}") >= in_share) & (F.col("med") >= b)).alias(f"n{i}") for i, (a, b) in enumerate(grid)]
    one = per.agg(*made)
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(a)).alias("min_share"), F.lit(float(b)).alias("min_count"), F.col(f"n{i}").alias("n_genes")) for i, (a, b) in enumerate(grid)])).alias("g")).select("g.*")


def column_outliers(df: DataFrame, column: str, value: str, n_std: float, low_limit: float = 0.0) -> DataFrame:
    """Rows of the groups whose mean is within n_std population deviations of the groups' mean; the lower bound counts only above ``low_limit``."""
    means = df.groupBy(column).agg(F.avg(value).alias("m"))
    bounds = means.agg(F.avg("m").alias("c"), F.stddev_pop("m").alias("s"))  # one row
    fit = means.crossJoin(F.broadcast(bounds)).where((F.col("m") <= F.col("c") + n_std * F.col("s")) & ((F.col("c") - n_std * F.col("s") <= low_limit) | (F.col("m") >= F.col("c") - n_std * F.col("s"))))
    return df.join(fit.select(column), column, "left_semi")


def tukey_fences(df: DataFrame, keys: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    """Quartiles, rounded first, and fences by group; the fences are null where two quartiles are equal."""
    q = df.groupBy(*keys).agg(*[F.round(F.percentile(value, p), digits).alias(n) for n, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    spread = (F.col("q1") != F.col("q2")) & (F.col("q2") != F.col("q3"))
    width = 1.5 * (F.col("q3") - F.col("q1"))
    return q.withColumns({"low": F.when(spread, F.col("q1") - width), "high": F.when(spread, F.col("q3") + width)})


def without_tukey_outliers(df: DataFrame, keys: Sequence[str], value: str, digits: int = 2) -> DataFrame:
    f = tukey_fences(df, keys, value, digits)
    ok = F.col("low").isNull() | F.col(value).between(F.col("low"), F.col("high"))
    return df.join(f, list(keys)).where(ok).select(df.columns)


def pathway_modulation(df: DataFrame, key: str, case: str, value: str, first: str, last: str, cut: float, similar: bool | None = None, way: str = "all") -> DataFrame:
    """Values of two cases side by side, nulls as 0 before the difference; ``similar`` keeps |difference| below the cut, or not below; ``way`` keeps ups or downs."""
    p = df.groupBy(key).pivot(case, [first, last]).agg(F.avg(value)).fillna(0.0, [first, last])
    p = p.withColumn("diff", F.col(last) - F.col(first)).withColumn("abs_diff", F.abs("diff"))
    if similar is not None:
        p = p.where(F.col("abs_diff") < cut if similar else F.col("abs_diff") >= cut)
    return p if way == "all" else p.where(F.col("diff") >= cut if way == "up" else F.col("diff") <= -cut)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark cuts groups down before the shuffle too."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
