"""Matrix and clustering operators: pyspark.ml where it has the method, numpy over bounded blocks where it has not."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.aggregates import exact_mean


def _vectors(df: DataFrame, array: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))


def principal_components(df: DataFrame, array: str, k: int) -> DataFrame:
    v = _vectors(df, array)
    return PCA(k=k, inputCol="features", outputCol="__p").fit(v).transform(v).withColumn("pcs", vector_to_array("__p")).drop("features", "__p")


def clustered(df: DataFrame, array: str, k: int, method: str = "kmeans", seed: int = 42) -> DataFrame:
    """Cluster numbers by k-means, bisecting k-means or a Gaussian mixture."""
    v = _vectors(df, array)
    kinds = {"kmeans": KMeans, "bisecting": BisectingKMeans, "mixture": GaussianMixture}
    model = kinds[method](k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v)
    return model.transform(v).drop("features", "probability")


def silhouettes(df: DataFrame, array: str, ks: Sequence[int], method: str = "kmeans") -> list[tuple[int, float]]:
    """Mean silhouette of each number of clusters; the largest is the choice."""
    out = []
    for k in ks:
        c = _vectors(clustered(df, array, k, method), array)
        out.append((k, ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(c)))
    return out


def em_fractions(bulk: DataFrame, reference: dict[str, dict[str, float]], sample: str, gene: str, count: str, rounds: int = 1000, tol: float = 1e-7) -> DataFrame:
    """Cell-state fractions of each bulk sample by fixed-point EM on reference profiles; rows (sample, state, theta).

    Samples are independent, so each is a group; the reference, of thousands of genes and tens of states, goes with the function.
    """
    states = sorted(reference)
    genes = sorted({g for p in reference.values() for g in p})
    place = {g: i for i, g in enumerate(genes)}
    phi = np.array([[reference[s].get(g, 0.0) for g in genes] for s in states]) + 1e-9
    phi /= phi.sum(1, keepdims=True)
    kind = dict(bulk.dtypes)[sample]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(len(genes))
        for name, c in zip(g[gene], g[count], strict=True):
            if name in place:
                x[place[name]] += c
        theta = np.full(len(states), 1 / len(states))
        for _ in range(rounds):
            new = theta * ((x / (theta @ phi)) @ phi.T)
            new = new / new.sum() if new.sum() > 0 else theta
            if np.abs(new - theta).max() < tol:
                theta = new
                break
            theta = new
        return pd.DataFrame({sample: g[sample].iloc[0], "state": states, "theta": theta})

    return bulk.select(sample, gene, count).groupBy(sample).applyInPandas(run, f"{sample} {kind}, state string, theta double")


def nonnegative_weights(a: np.ndarray, b: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Least squares with weights of 0 or more, by accelerated projected gradients, scaled to a sum of 1."""
    step = 1 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    w = y = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * (a.T @ (a @ y - b)), 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - w)
        if np.abs(new - w).max() < 1e-12:
            break
        w, t = new, t2
    return w / w.sum() if w.sum() > 0 else w


def marker_genes(df: DataFrame, state: str, gene: str, cpm: str, margin: float = 0.5, n: int = 200) -> DataFrame:
    """Genes whose log2 level in a state exceeds their level in every other by more than the margin, the n best of each."""
    from larkspan.operators.filters import top_per_group

    x = df.select(state, gene, F.log2(F.col(cpm) + 1).alias("l"))
    two = x.groupBy(gene).agg(F.reverse(F.array_sort(F.collect_list("l"))).alias("__t"), F.max_by(state, F.struct("l", state)).alias("top"))  # as many values as states
    first = two.withColumn("gap", F.get("__t", F.lit(0)) - F.coalesce(F.get("__t", F.lit(1)), F.lit(0.0))).where(F.col("gap") > margin)
    return top_per_group(first.select(F.col("top").alias(state), gene, "gap"), [state], [F.desc("gap"), F.col(gene)], n)


def signature_calls(df: DataFrame, sample: str, gene: str, z: str, up: Sequence[str], down: Sequence[str], names: tuple[str, str] = ("basal-like", "classical")) -> DataFrame:
    """Mean z of two gene lists by sample, their difference and the call."""
    one = lambda g: F.when(F.col(gene).isin(list(g)), F.col(z))
    s = df.withColumns({"__u": one(up), "__d": one(down)}).groupBy(sample).agg(exact_mean("__u").alias("up_score"), exact_mean("__d").alias("down_score"))
    return s.withColumn("delta", F.col("up_score") - F.col("down_score")).withColumn("call", F.when(F.col("delta") > 0, names[0]).otherwise(names[1]))


def jensen_shannon(df: DataFrame, keys: Sequence[str], p: str, q: str) -> DataFrame:
    """Divergence in bits of two weight columns, each scaled to a sum of 1."""
    s = df.groupBy(*keys).agg(F.sum(p).alias("__sp"), F.sum(q).alias("__sq"))
    x = df.join(s, list(keys)).withColumns({"__p": F.col(p) / F.col("__sp"), "__q": F.col(q) / F.col("__sq")})
    m = (F.col("__p") + F.col("__q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return x.groupBy(*keys).agg((F.sum(part("__p")) / 2 + F.sum(part("__q")) / 2).alias("js"))


def feasible_states(df: DataFrame, axes: Sequence[str], least: int, most: int = 10_000) -> DataFrame:
    """How many samples each combination of axis levels has, those with none as well, and whether that is enough. Nulls are no level; more than ``most`` combinations are an error."""
    grid, cells = None, 1
    for a in axes:
        values = df.select(a).where(F.col(a).isNotNull()).distinct()
        cells *= values.count()
        if cells > most:
            raise ValueError(f"the axes have more than {most} combinations")
        grid = values if grid is None else grid.crossJoin(values)  # ``most`` rows at most
    n = df.groupBy(*axes).agg(F.count("*").alias("n"))
    return grid.join(n, list(axes), "left").fillna(0, ["n"]).withColumn("usable", F.col("n") >= least)


def flags(conditions: dict[str, object]):
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(c, n) for n, c in conditions.items()]))
