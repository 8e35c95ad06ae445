"""What follows from cell-state fractions: expected counts by state, updated references, the two-part refit, and the least-squares baseline. Joins and aggregations over long tables but for small solvers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.ml import nonnegative_weights

FLOOR = 1e-9


def profiles(reference: DataFrame, state: str = "state", gene: str = "gene", level: str = "level") -> DataFrame:
    """Rows (state, gene, phi): each state's levels plus a slight floor over their sum, every gene of the reference for every state."""
    levels = reference.groupBy(F.col(state).alias("state"), F.col(gene).alias("gene")).agg(F.sum(level).cast("double").alias("level"))
    states = levels.groupBy().agg(F.collect_set("state").alias("s"))  # tens of names
    grid = levels.select("gene").distinct().crossJoin(F.broadcast(states)).select("gene", F.explode("s").alias("state"))
    full = grid.join(levels, ["state", "gene"], "left").withColumn("level", F.coalesce("level", F.lit(0.0)) + FLOOR)
    return full.join(full.groupBy("state").agg(F.sum("level").alias("t")), "state").select("state", "gene", (F.col("level") / F.col("t")).alias("phi"))


def expected_counts(bulk: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """Rows (sample, state, gene, z): how many of a gene's counts in a sample each state is expected to have given: count * theta * phi over the sum of theta * phi.

    bulk: (sample, gene, count); theta: (sample, state, theta); phi: (state, gene, phi). Genes that the reference lacks, and samples without fractions, have no rows. The work is one row for each count and state.
    """
    parts = bulk.groupBy("sample", "gene").agg(F.sum("count").cast("double").alias("count")).join(phi, "gene").join(theta.select("sample", "state", "theta"), ["sample", "state"]).withColumn("__w", F.col("theta") * F.col("phi"))
    total = parts.groupBy("sample", "gene").agg(F.sum("__w").alias("__t"))
    return parts.join(total, ["sample", "gene"]).select("sample", "state", "gene", F.when(F.col("__t") > 0, F.col("count") * F.col("__w") / F.col("__t")).otherwise(0.0).alias("z"))


def state_expression(z: DataFrame, state: str) -> DataFrame:
    """Rows (sample, gene, cpm) of one state; null for a sample to which the state gives nothing."""
    own = z.where(F.col("state") == state)
    total = own.groupBy("sample").agg(F.sum("z").alias("t"))
    return own.join(total, "sample").select("sample", "gene", F.when(F.col("t") > 0, F.col("z") / F.col("t") * 1e6).alias("cpm"))


def compartment_share(z: DataFrame, gene: str) -> DataFrame:
    """Rows (state, share): of one gene's counts over all samples."""
    own = z.where(F.col("gene") == gene).groupBy("state").agg(F.sum("z").alias("z"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("z").alias("t")))).select("state", F.when(F.col("t") > 0, F.col("z") / F.col("t")).alias("share"))


def updated_reference(z: DataFrame, malignant: list) -> tuple[DataFrame, DataFrame]:
    """(sample, gene, psi) of what the malignant states give in each sample, and (gene, psi) of what all others give in all samples; both sum to 1."""
    mal = z.where(F.col("state").isin(malignant)).groupBy("sample", "gene").agg(F.sum("z").alias("z"))
    mal = mal.join(mal.groupBy("sample").agg(F.sum("z").alias("t")), "sample").select("sample", "gene", F.when(F.col("t") > 0, F.col("z") / F.col("t")).otherwise(0.0).alias("psi"))
    env = z.where(~F.col("state").isin(malignant)).groupBy("gene").agg(F.sum("z").alias("z"))
    env = env.crossJoin(F.broadcast(env.agg(F.sum("z").alias("t")))).select("gene", F.when(F.col("t") > 0, F.col("z") / F.col("t")).otherwise(0.0).alias("psi"))  # one row beside
    return mal, env


def refitted(bulk: DataFrame, malignant: DataFrame, rest: DataFrame, rounds: int = 1000, tol: float = 1e-9) -> DataFrame:
    """Rows (sample, purity): the malignant fraction of each sample by the fixed point of a two-part mixture of its own malignant profile and the common other one. One small group for each sample."""
    x = bulk.groupBy("sample", "gene").agg(F.sum("count").cast("double").alias("count"))
    rows = x.join(malignant.withColumnRenamed("psi", "a"), ["sample", "gene"]).join(rest.withColumnRenamed("psi", "b"), "gene")
    kind = dict(bulk.dtypes)["sample"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, a, b = (g[c].to_numpy(float) for c in ("count", "a", "b"))
        p = 0.5
        for _ in range(rounds):
            own = p * a
            whole = own + (1 - p) * b
            share = n * own / np.maximum(whole, 1e-300)
            other = n * (1 - p) * b / np.maximum(whole, 1e-300)
            total = share.sum() + other.sum()
            new = share.sum() / total if total > 0 else p
            done = abs(new - p) < tol
            p = new
            if done:
                break
        return pd.DataFrame({"sample": [g["sample"].iloc[0]], "purity": [p]})

    return rows.select("sample", "gene", "count", "a", "b").groupBy("sample").applyInPandas(run, f"sample {kind}, purity double")


def nnls_fractions(bulk: DataFrame, phi: DataFrame) -> DataFrame:
    """Rows (sample, state, weight): least squares of each sample's gene shares on the profiles with no negative weight, scaled to 1. Samples are groups; genes that one side lacks are left out."""
    x = bulk.groupBy("sample", "gene").agg(F.sum("count").cast("double").alias("count"))
    wide = phi.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("state", "phi"))).alias("p"))
    rows = x.join(wide, "gene")
    kinds = dict(bulk.dtypes)["sample"], dict(phi.dtypes)["state"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("gene")
        names = [r["state"] for r in g.p.iloc[0]]
        a = np.array([[r["phi"] for r in p] for p in g.p])
        y = g["count"].to_numpy(float)
        w = nonnegative_weights(a, y / y.sum()) if y.sum() > 0 else np.full(len(names), np.nan)
        return pd.DataFrame({"sample": g["sample"].iloc[0], "state": names, "weight": w})

    out = rows.groupBy("sample").applyInPandas(run, f"sample {kinds[0]}, state {kinds[1]}, weight double")
    return out.withColumn("weight", F.when(~F.isnan("weight"), F.col("weight")))
