"""Ordered analytics. Windows are partitioned by a key; where the whole table is one group, it is aggregated to its distinct values first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(v: Column) -> Column:
    """A number that never falls as a double grows: sign, exponent and eight bits after it. A window over buckets has some hundred thousand rows at most, whatever the group; NaN comes last, null gives null."""
    m = F.abs(v)
    e = F.greatest(F.lit(-1074.0), F.least(F.lit(1023.0), F.floor(F.log2(F.when((m > 0) & (m < float("inf")), m).otherwise(1.0))).cast("double")))
    part = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((m / F.pow(F.lit(2.0), e) - 1) * 256).cast("double")))
    size = F.when(m == float("inf"), F.lit(1 << 20)).otherwise(((e + 1075) * 256 + part + 1).cast("int"))
    return F.when(F.isnan(v), F.lit(1 << 21)).when(v == 0, F.lit(0)).when(v < 0, -size).when(v > 0, size)


def _beside(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """``a`` with the other columns of ``b``, whose ``on`` are unique; nulls match nulls."""
    other = b.withColumnsRenamed({c: f"__on_{i}" for i, c in enumerate(on)})
    return a.join(other, [F.col(f"`{c}`").eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)]).drop(*(f"__on_{i}" for i in range(len(on))))


def _counted(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The distinct values of each group with their count __c, bucket __b, how many rows come before them, __before, and the group's rows, __n.

    Running sums are taken over the buckets' totals and within each bucket, so a window never holds a whole group.
    """
    c = rows.groupBy(*keys, value).agg(F.count("*").alias("__c")).withColumn("__b", F.coalesce(_bucket(F.col(value).cast("double")), F.lit(-(1 << 21))))
    whole, first = Window.partitionBy(*keys), Window.unboundedPreceding
    totals = c.groupBy(*keys, "__b").agg(F.sum("__c").alias("__t"))
    totals = totals.select(*keys, "__b", F.coalesce(F.sum("__t").over(whole.orderBy("__b").rowsBetween(first, -1)), F.lit(0)).alias("__base"), F.sum("__t").over(whole).alias("__n"))
    inner = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(first, -1)
    return _beside(c, totals, [*keys, "__b"]).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__c").over(inner), F.lit(0))).drop("__base")


def fdr_bh(df: DataFrame, keys: Sequence[str], p: str, name: str = "fdr") -> DataFrame:
    """Step-up false discovery rate within keys: nulls and NaN count as 1, monotone, at most 1.

    Equal p values share one rate, which is found on their counts and joined to the rows. The least rate from a value on is that within its bucket and that of the buckets after it.
    """
    value = F.when(F.col(p).isNull() | F.isnan(F.col(p).cast("double")), 1.0).otherwise(F.col(p).cast("double"))
    rows = df.withColumn("__p", value)
    c = _counted(rows, keys, "__p").withColumn("__q", F.col("__p") * F.col("__n") / (F.col("__before") + F.col("__c")))
    after = Window.partitionBy(*keys).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    later = c.groupBy(*keys, "__b").agg(F.min("__q").alias("__m")).select(*keys, "__b", F.min("__m").over(after).alias("__m"))
    inner = Window.partitionBy(*keys, "__b").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    c = _beside(c, later, [*keys, "__b"]).withColumn(name, F.least(F.lit(1.0), F.min("__q").over(inner), F.col("__m")))
    return _beside(rows, c.select(*keys, "__p", name), [*keys, "__p"]).drop("__p")


def fdr_naive(df: DataFrame, keys: Sequence[str], p: str, name: str = "fdr") -> DataFrame:
    """p * n / average rank, at most 1, without the monotone step; nulls count as 1."""
    rows = df.withColumn("__p", F.coalesce(F.col(p).cast("double"), F.lit(1.0)))
    c = _counted(rows, keys, "__p")
    rank = F.col("__before") + (F.col("__c") + 1) / 2
    return _beside(rows, c.select(*keys, "__p", F.least(F.lit(1.0), F.col("__p") * F.col("__n") / rank).alias(name)), [*keys, "__p"]).drop("__p")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean; nulls are the least. Numbers are ranked by their counts, others (dates, strings) by a window over their group."""
    if dict(df.dtypes)[value].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean"):
        return _beside(df, _counted(df.select(*keys, value), keys, value).select(*keys, value, (F.col("__before") + (F.col("__c") + 1) / 2).alias(name)), [*keys, value])
    w = Window.partitionBy(*keys).orderBy(value)
    return df.withColumn(name, F.rank().over(w) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2)


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, name: str = "rho") -> DataFrame:
    r = average_rank(average_rank(df.dropna(subset=[a, b]), keys, a, "__a"), keys, b, "__b")
    return r.groupBy(*keys).agg(F.corr("__a", "__b").alias(name))


def zscore(df: DataFrame, keys: Sequence[str], value: str, sample: bool = True, name: str = "z") -> DataFrame:
    """Standard scores within keys, by the sample's or the population's deviation; moments are aggregated, not windowed."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("__m"), (F.stddev_samp if sample else F.stddev_pop)(value).alias("__s"))
    return df.join(s, list(keys)).withColumn(name, F.when(F.col("__s") != 0, (F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def enrichment_score(df: DataFrame, keys: Sequence[str], stat: str, hit: str, tie: str, name: str = "es") -> DataFrame:
    """Weighted running-sum score of the hits in each ranked list: the largest deviation, the first of equals; 0 if none or all are hits."""
    part = Window.partitionBy(*keys)
    order = part.orderBy(F.desc(stat), tie)
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    h = F.col(hit).cast("double")
    w = F.when(F.col(hit), F.abs(stat)).otherwise(0.0)
    rows = df.where(F.col(stat).isNotNull()).withColumns({"__h": F.sum(h).over(part), "__n": F.count("*").over(part), "__t": F.sum(w).over(part)})
    rows = rows.withColumns({"__p": F.sum(w).over(run), "__q": F.sum(1 - h).over(run), "__r": F.row_number().over(order)})
    dev = F.col("__p") / F.greatest("__t", F.lit(1e-12)) - F.col("__q") / F.nullif(F.col("__n") - F.col("__h"), F.lit(0.0))
    best = rows.withColumn("__d", dev).groupBy(*keys).agg(F.max_by("__d", F.struct(F.round(F.abs("__d"), 9), -F.col("__r"))).alias("d"), F.first("__h").alias("h"), F.first("__n").alias("n"))
    return best.select(*keys, F.when((F.col("h") == 0) | (F.col("h") == F.col("n")), 0.0).otherwise(F.col("d")).alias(name), F.col("h").cast("long").alias("n_hits"))


def connectivity(up: str = "es_up", down: str = "es_dn", least_hits: int | None = None) -> Column:
    """Half the difference of the two scores if their signs differ, else 0; null where a side has fewer hits than asked."""
    score = F.when(F.signum(up) == F.signum(down), 0.0).otherwise((F.col(up) - F.col(down)) / 2)
    return score if least_hits is None else F.when((F.col("n_up") >= least_hits) & (F.col("n_dn") >= least_hits), score)


def normalised_connectivity(df: DataFrame, groups: Sequence[str], score: str, name: str = "ncs") -> DataFrame:
    """A score over the mean size of the scores of its sign within its group; zeros stay 0."""
    m = df.groupBy(*groups).agg(F.avg(F.when(F.col(score) > 0, F.col(score))).alias("__p"), F.avg(F.when(F.col(score) < 0, -F.col(score))).alias("__m"))
    return df.join(m, list(groups)).withColumn(name, F.when(F.col(score) > 0, F.col(score) / F.col("__p")).when(F.col(score) < 0, F.col(score) / F.col("__m")).when(F.col(score) == 0, 0.0)).drop("__p", "__m")


def ends(df: DataFrame, keys: Sequence[str], value: str, tie: str, n: int) -> DataFrame:
    """The n least and the n greatest of each group, marked; a row can be both."""
    asc = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(value), tie)
    desc = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(value), tie)
    head = df.withColumn("rank", F.row_number().over(asc)).where(F.col("rank") <= n).withColumn("side", F.lit("bottom"))
    return head.union(df.withColumn("rank", F.row_number().over(desc)).where(F.col("rank") <= n).withColumn("side", F.lit("top")).select(head.columns))


def median_step(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Median difference of neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__d", F.col(order) - F.lag(order).over(w)).groupBy(*keys).agg(F.median("__d").alias("median_step"))


def median_split(df: DataFrame, keys: Sequence[str], value: str, name: str = "half") -> DataFrame:
    m = df.groupBy(*keys).agg(F.median(value).alias("__m"))
    return df.join(m, list(keys)).withColumn(name, F.when(F.col(value) > F.col("__m"), "high").otherwise("low")).drop("__m")


def correlations(df: DataFrame, unit: str, feature: str, value: str, target) -> DataFrame:
    """Pearson correlation of every feature with one, over the units both have."""
    one = df.where(F.col(feature) == target).select(unit, F.col(value).alias("__y"))
    return df.where(F.col(feature) != target).join(one, unit).groupBy(feature).agg(F.corr(value, "__y").alias("r"), F.count("*").alias("n"))


def correlation_matrix(df: DataFrame, unit: str, feature: str, value: str, most: int = 5000) -> DataFrame:
    """Rows (a, b, r, n): Pearson correlation of each pair of features, a before b, over the n units that both have.

    The result has a row for each pair, so more than ``most`` features are an error. A unit's features meet in one join on the unit; what is shuffled after it are partial moments of pairs.
    """
    if df.select(feature).distinct().count() > most:
        raise ValueError(f"more than {most} features")
    rows = df.where(F.col(value).isNotNull() & F.col(feature).isNotNull()).select(F.col(unit).alias("__u"), F.col(feature).alias("a"), F.col(value).cast("double").alias("__x"))
    other = rows.withColumnsRenamed({"a": "b", "__x": "__y"})
    return rows.join(other, "__u").where("a < b").groupBy("a", "b").agg(F.corr("__x", "__y").alias("r"), F.count("*").alias("n"))


def curve_choice(df: DataFrame, fdr: str, x: str, y: str, points: int = 3) -> DataFrame:
    """For each rate of a cutoff grid the correlation of cut and count, null under ``points`` points, and which rate is the first to have one."""
    c = df.groupBy(fdr).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).withColumn("r", F.when(F.col("n") >= points, F.col("r")))
    first = c.where("r is not null").agg(F.min(fdr).alias("__f"))
    return c.crossJoin(F.broadcast(first)).withColumn("chosen", F.coalesce(F.col(fdr) == F.col("__f"), F.lit(False))).drop("__f")


def verified_chain(df: DataFrame, keys: Sequence[str], seq: str, prev: str, own: str, digest: Column, payload_ok: Column) -> DataFrame:
    """What is wrong with each event of hash-chained logs: null if nothing is."""
    before = F.coalesce(F.lag(own).over(Window.partitionBy(*keys).orderBy(seq)), F.lit(""))
    return df.withColumn("fault", F.when(F.col(prev) != before, "chain").when(~payload_ok, "payload").when(digest != F.col(own), "hash"))
