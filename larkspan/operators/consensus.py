"""Consensus clustering over landmarks, signatures tested on held-out units, and non-negative factorisation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.operators.lineage import Steps
from larkspan.operators.windows import fdr_bh

LANDMARKS = 1_000  # units whose pairs are counted: a resample's distances are 8 MB at most, however many units there are
MOST_FACTOR = 1 << 21  # numbers of the factor that all rows share
CDF_STEPS = 100


def distances(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((x - row) ** 2).sum(-1) for row in x]))


def linkage_labels(d: np.ndarray, ks: Sequence[int]) -> dict[int, np.ndarray]:
    """Average-linkage clusters for each number of clusters, labelled by first appearance; ties go to the pair that comes first. Tables of over LANDMARKS rows are refused."""
    n = len(d)
    if n > LANDMARKS:
        raise ValueError(f"linkage takes {LANDMARKS} rows at most")
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    out, want = {}, {min(k, n) for k in ks}
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    least, at = (d.min(1), d.argmin(1)) if n > 1 else (np.full(n, np.inf), np.zeros(n, int))
    for left in range(n, 0, -1):
        if left in want:
            out[left] = pd.factorize(label)[0]
        if left <= min(want, default=1):
            break
        i = int(np.argmin(least))
        j = int(at[i])
        i, j = min(i, j), max(i, j)
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        merged[~alive] = np.inf
        merged[[i, j]] = np.inf
        d[i], d[:, i] = merged, merged
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
        least[j] = np.inf
        stale = np.flatnonzero(alive & ((at == i) | (at == j) | (merged <= least)))
        stale = np.union1d(stale, [i])
        least[stale], at[stale] = d[stale].min(1), d[stale].argmin(1)
    return {k: out[min(k, n)] for k in ks}


def landmarks(df: DataFrame, id_col: str, array: str, most: int = LANDMARKS, seed: int = 1) -> DataFrame:
    """Rows (place, id, x) of the ``most`` units with the least hashes, all units if there are no more, numbered by id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x")).where("id is not null and x is not null")
    few = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
    return few.withColumn("place", F.row_number().over(Window.orderBy("id")) - 1)  # ``most`` rows


def consensus(df: DataFrame, id_col: str, array: str, ks: Sequence[int], repeats: int = 50, share: float = 0.8, most: int = LANDMARKS, tolerance: float = 0.02, min_fraction: float = 0.0, low: float = 0.1, high: float = 0.9, seed: int = 1) -> DataFrame:
    """How stable each number of clusters is: rows (k, pac, cdf, smallest, n_landmarks, chosen, ids, labels).

    Resamples of the landmarks, picked by hashes, are clustered by average linkage, each resample a task and one tree for all k. Of two landmarks that were in some resample together the consensus is the
    share of those in which they had one cluster. pac is the share of such pairs between low and high; cdf its distribution in steps of 0.01; labels cluster the landmarks (ids) by 1 - consensus; smallest
    is the least cluster's share of them. chosen is the smallest k whose pac is within ``tolerance`` of the least one of those whose clusters all have min_fraction, or of all if none has.

    Up to ``most`` units all of them are landmarks, and the result is that of all pairs; beyond, memory stays the same: a resample's distances, and a counter for each pair of landmarks. No rows give no rows.
    """
    if most > LANDMARKS:
        raise ValueError(f"{LANDMARKS} landmarks at most")
    steps = Steps(df.sparkSession)
    ks = sorted(set(ks))
    few = steps.write(landmarks(df, id_col, array, most, seed))
    kind = dict(few.dtypes)["id"]
    rows = few.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).where(F.pmod(F.xxhash64(F.lit(seed), "rep", "id"), F.lit(1000)) < int(share * 1000))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        cuts = linkage_labels(distances(np.stack(g.x.to_numpy()).astype(float)), ks)
        return pd.DataFrame({"k": ks, "places": [g.place.tolist()] * len(ks), "clusters": [cuts[k].tolist() for k in ks]})

    runs = steps.write(rows.groupBy("rep").applyInPandas(one, "k int, places array<int>, clusters array<int>"))
    names = few.groupBy().agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda s: s["id"]).alias("ids"))

    def count(g: pd.DataFrame) -> pd.DataFrame:
        n = max(max(p) for p in g.places) + 1
        both, same = np.zeros((n, n), np.int32), np.zeros((n, n), np.int32)
        for p, c in zip(g.places, g.clusters, strict=True):
            p, c = np.asarray(p), np.asarray(c)
            both[np.ix_(p, p)] += 1
            same[np.ix_(p, p)] += c[:, None] == c[None, :]
        up = np.triu_indices(n, 1)
        seen = both[up] > 0
        v = same[up][seen] / both[up][seen]
        share_ = np.where(both > 0, same / np.maximum(both, 1), 0.0)
        np.fill_diagonal(share_, 1.0)
        k = int(g.k.iloc[0])
        label = linkage_labels(1 - share_, [k])[k]
        edges = np.arange(CDF_STEPS + 1) / CDF_STEPS
        cdf = np.searchsorted(np.sort(v), edges + 1e-12, "right") / max(len(v), 1)
        return pd.DataFrame({"k": [k], "pac": [float(((v > low) & (v < high)).mean()) if len(v) else 0.0], "cdf": [cdf.tolist()], "smallest": [float(np.bincount(label).min() / n)], "n_landmarks": [n], "labels": [label.tolist()]})

    told = steps.write(runs.groupBy("k").applyInPandas(count, "k int, pac double, cdf array<double>, smallest double, n_landmarks int, labels array<int>"))
    fit = F.col("smallest") >= min_fraction
    best = told.agg(F.coalesce(F.min(F.when(fit, F.col("pac"))), F.min("pac")).alias("__best"), F.max(fit.cast("int")).alias("__any"))
    ok = (F.col("pac") <= F.col("__best") + tolerance) & (fit | (F.col("__any") == 0))
    choice = told.crossJoin(F.broadcast(best)).agg(F.min(F.when(ok, F.col("k"))).alias("__k"))
    # one row each
    return told.crossJoin(F.broadcast(choice)).crossJoin(F.broadcast(names)).select("k", "pac", "cdf", "smallest", "n_landmarks", (F.col("k") == F.col("__k")).alias("chosen"), F.col("ids").cast(f"array<{kind}>").alias("ids"), "labels")


def consensus_labels(df: DataFrame, id_col: str, array: str, ks: Sequence[int], **options) -> DataFrame:
    """Rows (id_col, cluster) for the chosen k: landmarks as consensus() labels them, other units by the nearest mean of the landmarks' clusters."""
    row = consensus(df, id_col, array, ks, **options).where("chosen").select("ids", "labels").first()  # one row of LANDMARKS names at most
    kind = dict(df.dtypes)[id_col]
    if row is None:
        return df.select(id_col, F.lit(0).alias("cluster")).limit(0)
    spark = df.sparkSession
    own = spark.createDataFrame(list(zip(row.ids, row.labels, strict=True)), f"id {kind}, c int")
    rows = df.select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x")).where("id is not null and x is not null")
    means = rows.join(F.broadcast(own), "id").select("c", F.posexplode("x")).groupBy("c", "pos").agg(F.avg("col").alias("m")).groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
    centres = {r.c: r.m for r in means.collect()}  # one row for each cluster
    labels, m = sorted(centres), np.array([centres[c] for c in sorted(centres)])

    def nearest(x: pd.Series) -> pd.Series:
        v = np.stack(x.to_numpy()).astype(float)
        return pd.Series(np.array(labels)[((v[:, None] - m[None]) ** 2).sum(-1).argmin(1)], dtype="int32")

    told = rows.join(F.broadcast(own), "id", "left")
    return told.select(F.col("id").alias(id_col), F.coalesce("c", F.pandas_udf(nearest, "int")(F.col("x"))).alias("cluster"))


# --- held-out signatures


def heldout_signatures(df: DataFrame, id_col: str, array: str, k: int, splits: int = 50, share: float = 0.5, alpha: float = 0.05, reference: DataFrame | None = None, leave_out: bool = False, most: int = LANDMARKS, seed: int = 3) -> DataFrame:
    """Rows (cluster, feature, median_p, fdr_of_median, frac_splits_sig, mean_lfc, n_splits_tested): what tells clusters apart in units that had no part in making them.

    In each split, picked by hashes, one side's landmarks are clustered by average linkage; every unit of the other side goes to the cluster whose mean profile it correlates with most, and each feature is
    tested in it against the rest of that side by Welch's t. Sides hold no unit in common, but a unit is assigned by all its features, the tested one too, which still favours small p values; with leave_out each feature's test
    has the units assigned by the other features only, and p values hold for independent features. reference: rows (id_col, label); a split's clusters get the label that most of their units on the
    clustered side have, the least of equals, and clusters of one label are one. Without it clusters are numbered by the order of their least unit, which ties splits only loosely.

    All splits are one plan with the split as a key. Features are places in the array. A test needs two units on each side and some variance, else its p is 1 if the split has it at all. No rows give no rows.
    """
    spark = df.sparkSession
    steps = Steps(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x")).where("id is not null and x is not null")
    every = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(splits)))).withColumn("a", F.pmod(F.xxhash64(F.lit(seed), "rep", "id"), F.lit(1000)) < int(share * 1000))
    few = landmarks(df, id_col, array, most, seed).select("id")
    kind = dict(rows.dtypes)["id"]

    def grouped(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x = np.stack(g.x.to_numpy()).astype(float)
        if len(g) <= k:
            return pd.DataFrame({"rep": [], "id": [], "c": [], "m": []})
        c = linkage_labels(distances(x), [k])[k]
        return pd.DataFrame({"rep": g.rep.to_numpy(), "id": g.id.to_numpy(), "c": c, "m": [x[c == v].mean(0).tolist() for v in c]})

    made = steps.write(every.where("a").join(F.broadcast(few), "id", "left_semi").groupBy("rep").applyInPandas(grouped, f"rep int, id {kind}, c int, m array<double>"))
    if reference is None:
        name = made.select("rep", "c", F.col("c").cast("string").alias("cluster")).distinct()
    else:
        label = [c for c in reference.columns if c != id_col][0]
        told = made.select("rep", "id", "c").join(reference.select(F.col(id_col).alias("id"), F.col(label).cast("string").alias("cluster")), "id").groupBy("rep", "c", "cluster").agg(F.count("*").alias("n"))
        name = told.groupBy("rep", "c").agg(F.min(F.struct(-F.col("n"), "cluster")).alias("s")).select("rep", "c", "s.cluster")
    centres = made.groupBy("rep", "c").agg(F.first("m").alias("m")).join(name, ["rep", "c"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "m", "cluster"))).alias("all"))

    def nearest(xs: pd.Series, alls: pd.Series) -> pd.Series:
        """The cluster of each unit, once for each of its features."""
        out = []
        for x, cs in zip(xs, alls, strict=True):
            x, m = np.asarray(x, float), np.stack([np.asarray(c["m"], float) for c in cs])
            x, m = x - x.mean(), m - m.mean(1, keepdims=True)  # the correlation stays, and sums lose no digits
            less = (lambda v: v.sum(-1, keepdims=True) - v) if leave_out else (lambda v: np.broadcast_to(v.sum(-1, keepdims=True), v.shape))
            n = x.size - leave_out
            cov = less(m * x) - less(m) * less(x) / n
            size = np.sqrt(np.maximum(less(x * x) - less(x) ** 2 / n, 0)) * np.sqrt(np.maximum(less(m * m) - less(m) ** 2 / n, 0))
            names = [c["cluster"] for c in cs]
            out.append([names[i] for i in (cov / (size + 1e-12)).argmax(0)])
        return pd.Series(out, dtype=object)

    held = every.where("not a").join(centres, "rep").select("rep", F.posexplode(F.arrays_zip("x", F.pandas_udf(nearest, "array<string>")("x", "all").alias("c"))).alias("feature", "z")).select("rep", "feature", F.col("z.c").alias("cluster"), F.col("z.x").alias("v"))
    own = steps.write(held.groupBy("rep", "cluster", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("s")))
    whole = own.groupBy("rep", "feature").agg(F.sum("n").alias("tn"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("tm"))
    both = own.join(whole, ["rep", "feature"])
    apart = F.col("n") * (F.col("m") - F.col("tm")) * (F.col("m") - F.col("tm"))
    sums = both.groupBy("rep", "feature").agg(F.sum(F.col("s") + apart).alias("ts"))
    both = both.join(sums, ["rep", "feature"]).where("n > 1 and tn - n > 1")
    n2 = F.col("tn") - F.col("n")
    m2 = (F.col("tn") * F.col("tm") - F.col("n") * F.col("m")) / n2
    s2 = F.col("ts") - F.col("s") - apart - n2 * (m2 - F.col("tm")) * (m2 - F.col("tm"))
    e1, e2 = F.col("s") / (F.col("n") - 1) / F.col("n"), F.greatest(s2, F.lit(0.0)) / (n2 - 1) / n2
    tested = both.select("rep", "cluster", "feature", (F.col("m") - m2).alias("lfc"), e1.alias("e1"), e2.alias("e2"), "n", n2.alias("n2"))
    e = F.col("e1") + F.col("e2")
    t = F.when(e > 0, F.col("lfc") / F.sqrt(e))
    df_ = F.when(e > 0, e * e / (F.col("e1") * F.col("e1") / (F.col("n") - 1) + F.col("e2") * F.col("e2") / (F.col("n2") - 1)))
    tested = tested.withColumns({"t": t, "df": df_})
    tested = tested.withColumn("p", F.coalesce(D.p_student(F.col("t"), F.col("df")), F.lit(1.0)))
    rates = steps.write(fdr_bh(tested.select("rep", "cluster", "feature", "lfc", "p"), ["rep", "cluster"], "p", "q"))
    out = rates.groupBy("cluster", "feature").agg(F.median("p").alias("median_p"), F.avg((F.col("q") < alpha).cast("double")).alias("frac_splits_sig"), F.avg("lfc").alias("mean_lfc"), F.count("*").alias("n_splits_tested"))
    return fdr_bh(out, ["cluster"], "median_p", "fdr_of_median")


# --- non-negative factorisation


def factorised(df: DataFrame, id_col: str, array: str, rank: int, rounds: int = 30, inner: int = 8, seed: int = 7, tol: float = 1e-7) -> tuple[DataFrame, np.ndarray, list[float]]:
    """(rows (id_col, weights), components, squared errors by round) of V = W H with nothing negative, by multiplicative updates.

    A round updates each row's weights ``inner`` times in its own task, then the shared components as often from the sums W'V and W'W, which Spark aggregates; no update lets the error rise. Weights are written each
    round. Stops when a round lowers the error by less than ``tol`` of it. Starts are hashes, so results don't depend on the order of rows. A negative or null entry is an error; a row of zeros has weights 0; no rows give no rows and
    components of length 0. Components hold rank * features numbers, MOST_FACTOR at most.
    """
    spark = df.sparkSession
    steps = Steps(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x")).where("id is not null and x is not null")
    shape = rows.agg(F.max(F.size("x")).alias("m"), F.min(F.size("x")).alias("l"), F.max(F.exists("x", lambda v: v.isNull() | (v < 0) | F.isnan(v))).alias("bad"), F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("ss"), F.avg(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("level")).first()
    if shape.m is None:
        return rows.select(F.col("id").alias(id_col), F.col("x").alias("weights")), np.zeros((rank, 0)), []
    if shape.bad or shape.m != shape.l:
        raise ValueError("arrays must be of one length, without nulls or negative numbers")
    m = shape.m
    if rank * m > MOST_FACTOR:
        raise ValueError(f"components of more than {MOST_FACTOR} numbers")
    h = np.random.default_rng(seed).uniform(0.5, 1.5, (rank, m)) * max(shape.level / m, 1e-12)
    start = F.transform(F.sequence(F.lit(1), F.lit(rank)), lambda j: 0.5 + F.pmod(F.xxhash64(F.lit(seed), "id", j), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    state = steps.write(rows.withColumn("w", start))
    kind, errors, tiny = dict(rows.dtypes)["id"], [], 1e-300
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(h)

        def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            h = held.value
            gram = h @ h.T
            for g in batches:
                if not len(g):
                    continue
                x, w = np.stack(g.x.to_numpy()).astype(float), np.stack(g.w.to_numpy()).astype(float)
                cross = x @ h.T
                for _ in range(inner):
                    w = w * cross / np.maximum(w @ gram, tiny)
                yield pd.DataFrame({"id": g.id, "x": g.x, "w": list(w)})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((rank, rank + m))
            for g in batches:
                if len(g):
                    w = np.stack(g.w.to_numpy()).astype(float)
                    total += w.T @ np.concatenate([w, np.stack(g.x.to_numpy()).astype(float)], axis=1)
            yield pd.DataFrame({"j": np.arange(rank), "v": list(total)})

        before, state = state, steps.write(state.mapInPandas(weigh, f"id {kind}, x array<double>, w array<double>"))
        steps.drop(before)
        sums = state.mapInPandas(add, "j int, v array<double>").select("j", F.posexplode("v").alias("c", "v")).groupBy("j", "c").agg(F.sum("v").alias("v"))
        total = np.zeros((rank, rank + m))
        for r in sums.collect():  # rank * (rank + m) numbers
            total[r.j, r.c] = r.v
        gram, cross = total[:, :rank], total[:, rank:]
        for _ in range(inner):
            h = h * cross / np.maximum(gram @ h, tiny)
        errors.append(max(float(shape.ss - 2 * (h * cross).sum() + (gram * (h @ h.T)).sum()), 0.0))
        if len(errors) > 1 and errors[-2] - errors[-1] <= tol * errors[-2]:
            break
    return state.select(F.col("id").alias(id_col), F.col("w").alias("weights")), h, errors
