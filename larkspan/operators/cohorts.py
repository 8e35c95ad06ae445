"""Cohort work: studies side by side, sample metadata, perturbation signatures, selectivity and simulation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_across(df: DataFrame, study: str, key: str) -> DataFrame:
    """Rows of the keys that every study has."""
    n = df.agg(F.count_distinct(study).alias("n"))  # one row
    every = df.groupBy(key).agg(F.count_distinct(study).alias("k")).crossJoin(F.broadcast(n)).where("k = n").select(key)
    return df.join(every, key, "left_semi")


def sample_metadata(studies: DataFrame, study: str, counts: dict[str, str]) -> DataFrame:
    """One row for each sample of each study, numbered within condition; counts: condition by column of its sample count."""
    parts = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(n).alias("n")) for c, n in counts.items()])
    rows = studies.select(study, F.explode(parts).alias("p")).where("p.n > 0")
    rows = rows.select(study, "p.condition", F.explode(F.sequence(F.lit(1), F.col("p.n").cast("int"))).alias("number"))
    return rows.withColumn("sample", F.concat_ws("_", study, "condition", "number"))


def controls(n_normal: Column, n_reference: Column, least: int = 3) -> Column:
    """Which controls a comparison takes: its own normals, the reference tissue, or none."""
    return F.when(n_normal >= least, "normal").when(n_reference >= least, "reference").otherwise("none")


def first_known(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The first value of each key that is not null, null if there is none."""
    return df.groupBy(key).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias(value))


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def sectors(columns: Sequence[str], up: float, down: float) -> dict[str, Column]:
    """Over several case columns: the ups, the downs, whether any is strong, whether both signs are, and the spread."""
    named = F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias("v")) for c in columns])
    names = lambda f: F.transform(F.filter(named, f), lambda s: s["case"])
    some = lambda f: F.exists(named, f)
    return {
        "ups": names(lambda s: s["v"] > up),
        "downs": names(lambda s: s["v"] < -down),
        "strong": some(lambda s: F.abs(s["v"]) >= up),
        "both_signs": some(lambda s: s["v"] >= up) & some(lambda s: s["v"] <= -down),
        "spread": F.greatest(*columns) - F.least(*columns),
    }


def treated_minus_vehicle(df: DataFrame, line: str, gene: str, drug: str, value: str, vehicle: str, least: int = 1) -> DataFrame:
    """Mean of each drug less the mean of the vehicle in the same line, of drugs with ``least`` genes."""
    m = df.groupBy(line, drug, gene).agg(F.avg(value).alias("m"))
    base = m.where(F.col(drug) == vehicle).select(line, gene, F.col("m").alias("v"))
    d = m.where(F.col(drug) != vehicle).join(base, [line, gene]).withColumn("shift", F.col("m") - F.col("v"))
    big = d.groupBy(line, drug).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(line, drug)
    return d.join(big, [line, drug], "left_semi").select(line, drug, gene, "shift")


def context_dependence(df: DataFrame, drug: str, value: str) -> DataFrame:
    return df.groupBy(drug).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).orderBy(F.desc_nulls_last("sd"), drug)


def selectivity(df: DataFrame, gene: str, value: str, strong: float = -0.6, common: float = 0.8) -> DataFrame:
    """Share of models that depend on a gene, and what that makes it."""
    s = df.groupBy(gene).agg(F.avg((F.col(value) < strong).cast("double")).alias("share"), F.avg(value).alias("mean"))
    return s.withColumn("label", F.when(F.col("share") >= common, "common").when(F.col("share") > 0, "selective").otherwise("none"))


def quadrant(response: Column, fitness: Column, cut: Column) -> Column:
    return F.when((response > 0) & (fitness <= cut), "responds and dies").when(response > 0, "responds").when(fitness <= cut, "dies").otherwise("neither")


def centred_assignment(df: DataFrame, unit: str, feature: str, value: str, centroids: DataFrame, cluster: str) -> DataFrame:
    """The centroid with which each unit correlates best; centroids: (cluster, feature, value)."""
    c = df.join(centroids.select(cluster, feature, F.col(value).alias("__c")), feature).groupBy(unit, cluster).agg(F.corr(value, "__c").alias("r"))
    return c.groupBy(unit).agg(F.max_by(cluster, F.struct(F.coalesce("r", F.lit(-2.0)), cluster)).alias(cluster), F.max("r").alias("r"))


def random_set_overlaps(universe: DataFrame, gene: str, sets: DataFrame, set_col: str, n_draw: int, n_sim: int, seed: int = 7) -> DataFrame:
    """Overlap of each gene set with random draws, by simulation: rows (sim, set, overlap). A draw is the n_draw genes of the least hashes with the simulation's number."""
    u = universe.select(gene).distinct()
    n = u.agg(F.count("*").cast("double").alias("__n"))  # one row
    # hashes are even over 64 bits: this share of the least has all that are drawn, but for ten deviations
    share = F.least(F.lit(1.0), F.lit(n_draw + 10 * n_draw**0.5 + 50) / F.col("__n"))
    h = F.xxhash64(F.lit(seed), "sim", gene)
    near = u.crossJoin(F.broadcast(n)).withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n_sim).cast("long")))).withColumn("__h", h).where(F.col("__h").cast("double") <= share * 2.0**64 - 2.0**63)
    w = Window.partitionBy("sim").orderBy("__h", gene)
    drawn = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n_draw).select("sim", gene)
    return drawn.join(sets.select(set_col, gene).distinct(), gene).groupBy("sim", set_col).agg(F.count("*").alias("overlap"))


def empirical_p(observed: DataFrame, simulated: DataFrame, set_col: str, n_sim: int) -> DataFrame:
    """(simulations with an overlap as large + 1) / (simulations + 1); observed: (set, overlap)."""
    o = observed.select(set_col, F.col("overlap").alias("seen"))
    hit = o.join(simulated, set_col, "left").groupBy(set_col, "seen").agg(F.count_if(F.col("overlap") >= F.col("seen")).alias("k"))
    return hit.select(set_col, "seen", ((F.col("k") + 1) / (n_sim + 1)).alias("pval"))


def bayesian_cutoff(counts: DataFrame, lfc: str, n_degs: str, total: int, mean: float, std: float, level: float = 0.95) -> DataFrame:
    """Posterior over a grid of LFC cutoffs: likelihood n_degs / total, folded normal prior; the mean, the mode and a central interval. The grid has tens of rows."""
    from larkspan.operators.evidence import normal_cdf

    z = (F.col(lfc) - mean) / std
    prior = 2 * (1 - normal_cdf(F.abs(z)))
    p = counts.withColumn("__w", F.col(n_degs) / total * prior)
    s = p.agg(F.sum("__w").alias("__s"))
    w = Window.orderBy(lfc).rowsBetween(Window.unboundedPreceding, 0)
    p = p.crossJoin(F.broadcast(s)).withColumn("post", F.col("__w") / F.col("__s")).withColumn("__c", F.sum("post").over(w))
    tail = (1 - level) / 2
    return p.agg(F.sum(F.col(lfc) * F.col("post")).alias("mean"), F.max_by(lfc, "post").alias("mode"), F.min(F.when(F.col("__c") >= tail, F.col(lfc))).alias("low"), F.min(F.when(F.col("__c") >= 1 - tail, F.col(lfc))).alias("high"))


def stacked_quantiles(df: DataFrame, key: str, points: Sequence[float]) -> DataFrame:
    """Quantiles of all value columns together."""
    long = df.unpivot([key], [c for c in df.columns if c != key], "column", "value")
    return long.agg(F.percentile("value", list(points)).alias("q")).select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*map(F.lit, points)), F.col("i")).alias("point"), "value")
