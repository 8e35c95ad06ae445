"""Aggregation and reshaping: partial aggregates go before every shuffle, and tables stay long until a small pivot at the end."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_mean(value: str) -> Column:
    """Mean of a column of doubles by their sum as decimals of 18 places: whatever order rows come in, equal means are equal and a mean of 0.05 is 0.05. Where a value is no such decimal (NaN, 1e20), the plain mean."""
    d = F.col(value).try_cast("decimal(38,18)")
    return F.when(F.count(d) == F.count(value), F.coalesce(F.try_divide(F.try_sum(d), F.count(d)).cast("double"), F.avg(value))).otherwise(F.avg(value))


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """A table read from Parquet with each row's place in it: its file by path, where there are several, and its number there."""
    row = F.col("_metadata.row_index")
    return df.select("*", (row if len(df.inputFiles()) == 1 else F.struct("_metadata.file_path", "_metadata.row_index")).alias(name))


def mean_in_order(df: DataFrame, keys: Sequence[str], value: str, order: str, name: str) -> DataFrame:
    """Mean of a column of doubles by keys, added up in one order. Sums of doubles differ in their last bit by the order of additions, which decides between means that are equal; partial sums come in any order. All rows are shuffled for it, none are held."""
    rows = df.select(*keys, order, value).repartition(*keys).sortWithinPartitions(*keys, order)
    return rows.groupBy(*keys).agg(F.avg(value).alias(name))  # partitioned already, so each group is one running sum over sorted rows


def counts(df: DataFrame, keys: Sequence[str], drop_null_keys: bool = False, name: str = "n") -> DataFrame:
    """Group sizes; groups with a null key stay or go."""
    rows = df.dropna(subset=list(keys)) if drop_null_keys else df
    return rows.groupBy(*keys).agg(F.count("*").alias(name))


def distinct_counts(df: DataFrame, key: str, item: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(item).alias(name))


def filled_counts(df: DataFrame, key: str, counted: str, name: str = "n") -> DataFrame:
    """Rows whose ``counted`` is not null, by key."""
    return df.groupBy(key).agg(F.count(counted).alias(name))


def supported(df: DataFrame, keys: Sequence[str], sample: str, share: float) -> DataFrame:
    """Keys found in strictly more than ``share`` of the samples, with the number of samples."""
    total = df.agg(F.count_distinct(sample).alias("total"))  # one row
    per = df.groupBy(*keys).agg(F.count_distinct(sample).alias("n"))
    return per.crossJoin(F.broadcast(total)).where(F.col("n") >= F.floor(F.col("total") * share) + 1).drop("total")


def best_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep_null_keys: bool = False) -> DataFrame:
    """The first row of each key by ``order``; rows with a null key go, or all stay."""
    null = functools.reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.where(~null).withColumn("__n", n).where("__n = 1").drop("__n")
    return out.union(df.where(null).select(out.columns)) if keep_null_keys else out


def pseudobulk(df: DataFrame, keys: Sequence[str], unit: str, feature: str, value: str, at_least: int) -> DataFrame:
    """Sums by (keys, feature) of the groups with ``at_least`` units."""
    big = df.groupBy(*keys).agg(F.count_distinct(unit).alias("u")).where(F.col("u") >= at_least).select(*keys)
    return df.join(big, list(keys), "left_semi").groupBy(*keys, feature).agg(F.sum(value).alias(value))


def hash_sample(df: DataFrame, keys: Sequence[str], id_col: str, n: int, seed: int = 1) -> DataFrame:
    """Up to n rows of each group, by the order of a hash of the id: the same on every run."""
    from larkspan.operators.filters import top_per_group

    return top_per_group(df, keys, [F.xxhash64(F.lit(seed), id_col), F.col(id_col)], n)


def presence(df: DataFrame, row: str, column: str, min_columns: int, min_rows: int) -> DataFrame:
    """Distinct pairs of the rows with min_columns columns, and then of the columns with min_rows of those rows; blank keys go."""
    clean = lambda c: F.trim(F.col(c).cast("string"))
    p = df.select(clean(row).alias(row), clean(column).alias(column)).where(~F.lower(row).isin("", "nan") & ~F.lower(column).isin("", "nan")).distinct()
    p = p.join(p.groupBy(row).count().where(F.col("count") >= min_columns).select(row), row, "left_semi")
    return p.join(p.groupBy(column).count().where(F.col("count") >= min_rows).select(column), column, "left_semi").select(row, column)


def presence_matrix(pairs: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """0/1 columns of the chosen values."""
    return pairs.groupBy(row).pivot(column, list(columns)).agg(F.lit(1)).fillna(0)


def attribute_pivot(df: DataFrame, entity: str, attribute: str, value: str, attributes: Sequence[str]) -> DataFrame:
    """Entity-attribute-value rows side by side, names in lower case, the least value where there are several."""
    return df.withColumn(attribute, F.lower(attribute)).groupBy(entity).pivot(attribute, [a.lower() for a in attributes]).agg(F.min(value))


def mean_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.avg(value))


def crosstab(df: DataFrame, a: str, b: str, normalise: bool = False) -> DataFrame:
    """Long contingency table; shares of each a if ``normalise``."""
    t = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a))) if normalise else t


def per_million(df: DataFrame, sample: str, value: str) -> DataFrame:
    """cpm and log2(cpm + 1) within each sample; sample sums are aggregated first, so that no sample is one window."""
    sums = df.groupBy(sample).agg(F.sum(value).alias("__total"))
    cpm = F.when(F.col("__total") != 0, F.col(value) / F.col("__total") * 1e6)
    return df.join(sums, sample).withColumns({"cpm": cpm, "log_cpm": F.log2(cpm + 1)}).drop("__total")


def most_variable(df: DataFrame, key: str, value: str, n: int, forced: DataFrame | None = None) -> DataFrame:
    """The n keys of the largest sample variance, after the forced ones."""
    v = df.groupBy(key).agg(F.var_samp(value).alias("variance"))
    if forced is None:
        return v.orderBy(F.desc_nulls_last("variance"), key).limit(n)
    marked = v.join(forced.select(key).distinct().withColumn("forced", F.lit(1)), key, "left").fillna(0, ["forced"])
    return marked.orderBy(F.desc("forced"), F.desc_nulls_last("variance"), key).limit(n)


def entropy(df: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Shannon entropy of the weights in each group, its maximum, and their ratio (0 for one item).

    H = log2 S - (sum w log2 w) / S needs two sums, so no window over a group.
    """
    w = F.col(weight).cast("double")
    s = df.where(w > 0).groupBy(*keys).agg(F.sum(w).alias("s"), F.sum(w * F.log2(w)).alias("l"), F.count("*").alias("n_items"))
    h = F.log2("s") - F.col("l") / F.col("s")
    most = F.log2(F.col("n_items").cast("double"))
    return s.select(*keys, "n_items", h.alias("entropy"), most.alias("max_entropy"), F.when(F.col("n_items") > 1, h / most).otherwise(0.0).alias("norm_entropy"))


def score_partition(df: DataFrame, key: str, size: str, value: str, small: int = 3) -> DataFrame:
    """Size-weighted mean, mean, deviation of a value over the parts of each partition, with the parts' sizes."""
    return df.groupBy(key).agg(
        (F.sum(F.col(size) * F.col(value)) / F.sum(size)).alias("weighted"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(size).alias("min_size"),
        F.max(size).alias("max_size"),
        F.count_if(F.col(size) < small).alias("n_small"),
    )


def quantile_bins(df: DataFrame, value: str, n: int) -> DataFrame:
    """bin from 0 by linear-interpolation quantile edges, equal edges merged, the lowest value in the first bin."""
    edges = df.agg(F.percentile(value, [i / n for i in range(n + 1)]).alias("__e"))  # one row
    inner = F.slice("__e", 2, 1 << 20)
    distinct = F.array_distinct(inner)
    below = F.size(F.filter(distinct, lambda e: e < F.col(value)))
    low_merged = F.when(F.element_at(distinct, 1) == F.element_at("__e", 1), 1).otherwise(0)
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(below - low_merged, F.lit(0))).drop("__e")


def column_entropy(df: DataFrame, text: str, gap: str = "-", gap_share: float = 0.05) -> DataFrame:
    """Per character position: entropy, its standard error, the commonest character; rare gaps are left out."""
    chars = df.select(F.posexplode(F.split(text, "")).alias("pos", "ch")).where("ch <> ''").groupBy("pos", "ch").agg(F.count("*").alias("c"))
    w = Window.partitionBy("pos")  # one row for each character: bounded by the alphabet
    chars = chars.withColumn("all", F.sum("c").over(w)).where((F.col("ch") != gap) | (F.col("c") >= gap_share * F.col("all")))
    p = F.col("c") / F.sum("c").over(w)
    chars = chars.withColumn("p", p)
    term = 1 + F.log2("p")
    out = chars.groupBy("pos").agg(F.sum("c").alias("n"), (-F.sum(F.col("p") * F.log2("p"))).alias("h"), F.sum(term * term * F.col("p") * (1 - F.col("p"))).alias("v"), F.max_by("ch", F.struct(F.col("c"), F.col("ch"))).alias("best"))
    return out.select("pos", "n", F.col("h").alias("entropy"), (F.col("h") * F.sqrt(F.col("v") / F.col("n"))).alias("se"), "best")


def share_of_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    total = df.groupBy(*keys).agg(F.sum(value).alias("__t"))
    return df.join(total, list(keys)).withColumn("share", F.when(F.col("__t") != 0, F.col(value) / F.col("__t"))).drop("__t")


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, standard error, extremes, quartiles and variation of a value by group."""
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), *[F.percentile(value, p).alias(q) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])
    return out.withColumns({"sem": F.col("std") / F.sqrt("n"), "vc": F.when(F.col("mean") != 0, F.col("std") / F.abs("mean"))})


def regions(df: DataFrame, item: str, set_name: str, sets: Sequence[str]) -> DataFrame:
    """Number of items in each exclusive region of up to 63 sets, as a bit mask."""
    bit = functools.reduce(lambda rest, s: F.when(F.col(set_name) == s[1], F.lit(1 << s[0])).otherwise(rest), enumerate(sets), F.lit(0)).cast("long")
    return df.groupBy(item).agg(F.bit_or(bit).alias("mask")).where("mask > 0").groupBy("mask").agg(F.count("*").alias("n"))


def panel_members(df: DataFrame, panel: str, sep: str = ",") -> DataFrame:
    return df.withColumn(panel, F.explode(F.split(F.regexp_replace(panel, r"\s+", ""), sep)))


def tumour_qc(df: DataFrame, sample: str, gene: str, count: str, top: int = 50) -> DataFrame:
    """Library size, genes seen, zero share, median of what is seen, and the share of the ``top`` genes."""
    base = df.groupBy(sample).agg(F.sum(count).alias("library"), F.count_if(F.col(count) > 0).alias("n_detected"), F.avg((F.col(count) == 0).cast("double")).alias("frac_zero"), F.median(F.when(F.col(count) > 0, F.col(count))).alias("median_nonzero"))
    w = Window.partitionBy(sample).orderBy(F.desc(count), gene)
    heavy = df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).groupBy(sample).agg(F.sum(count).alias("t"))
    return base.join(heavy, sample, "left").withColumn("top_share", F.when(F.col("library") > 0, F.col("t") / F.col("library"))).drop("t")


def strandedness(first: Column, second: Column) -> Column:
    """Which strand's counts to use, by the ratio of their sums."""
    r = F.sum(first) / F.nullif(F.sum(second), F.lit(0))
    return F.when(r > 5, "first").when(r < 0.2, "second").otherwise("unstranded")


def first_best(columns: Sequence[str]) -> Column:
    """Name of the column of the largest value, the first of equals."""
    best = F.greatest(*columns)
    return F.coalesce(*[F.when(F.col(c) == best, F.lit(c)) for c in columns])


def concat_pivot(df: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Texts side by side, several of one cell joined in order."""
    return df.groupBy(row).pivot(column, list(columns)).agg(F.array_join(F.array_sort(F.collect_list(value)), "")).fillna("")
