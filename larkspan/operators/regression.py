"""Regression on several covariates from aggregated moments, and batch correction by empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.operators.expression import MOST_SAMPLES, _matrix

TOLERANCE = 1e-9


def _solved(gram: np.ndarray, cross: np.ndarray, total: float, n: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, float]:
    """Of centred moments: slopes, their unscaled variances, which covariates are identifiable, rank, residual sum of squares.

    Cholesky with pivots on the correlation scale: a covariate whose rest is below TOLERANCE of itself is a combination of those before it, and is left out.
    """
    p = len(gram)
    scale = np.sqrt(np.diagonal(gram).clip(min=0))
    safe = np.where(scale > 0, scale, 1.0)
    a = gram / np.outer(safe, safe)
    rest, order = np.where(scale > 0, 1.0, 0.0), []
    low = np.zeros((p, p))
    for k in range(p):
        i = int(np.argmax(rest))
        if rest[i] <= TOLERANCE:
            break
        low[:, k] = (a[:, i] - low[:, :k] @ low[i, :k]) / np.sqrt(rest[i])
        low[order, k] = 0.0
        low[i, k] = np.sqrt(rest[i])
        rest = rest - low[:, k] ** 2
        order.append(i)
        rest[order] = 0.0
    beta, var, ok = np.full(p, np.nan), np.full(p, np.nan), np.zeros(p, bool)
    if order:
        lower = low[order, : len(order)]
        inverse = np.linalg.inv(lower)
        full = inverse.T @ inverse
        beta[order] = full @ (cross[order] / safe[order]) / safe[order]
        var[order] = np.diagonal(full) / safe[order] ** 2
        ok[order] = True
    # a covariate in the same span as one that was left out has no estimate of its own either
    for j in np.flatnonzero(~ok):
        if order and scale[j] > 0:
            weight = full @ a[order, j]
            for i, w in zip(order, weight, strict=True):
                if abs(w) > 1e-6:
                    ok[i] = False
    used = np.array(order, int)
    rss = max(total - float(np.nansum(beta[used] * cross[used])), 0.0) if order else total
    return beta, var, ok, len(order), rss


def regression(df: DataFrame, keys: Sequence[str], y: str, covariates: Sequence[str]) -> DataFrame:
    """Least squares of y on the covariates and an intercept within keys: rows (keys, term, estimate, se, t, pval, identifiable, n, rank, df, r2, adj_r2, f, f_pval, bic).

    Rows with a null or NaN in y or a covariate are left out. The moments are one aggregation (covariances about the means, so large offsets cost no digits), and a group's normal equations are solved on its one row.
    A covariate that is constant or a combination of others within a group is not identifiable; nor is any that shares in the combination: their estimates are null, while the fit and its summary are those
    of the largest set that can be solved. t, se and p are null without residual degrees of freedom. bic is n log(rss / n) + (rank + 1) log n. Groups of no complete row give no rows.
    """
    p = len(covariates)
    names = [f"__x{i}" for i in range(p)]
    rows = df.select(*keys, F.col(y).cast("double").alias("__y"), *(F.col(c).cast("double").alias(n) for c, n in zip(covariates, names, strict=True)))
    rows = rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in ("__y", *names)))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"),
        F.avg("__y").alias("__m"),
        (F.var_pop("__y") * F.count("*")).alias("__t"),
        F.array(*(F.avg(c) for c in names)).alias("__mx"),
        F.array(*(F.covar_pop(names[i], names[j]) * F.count("*") for i, j in pairs)).alias("__g"),
        F.array(*(F.covar_pop(c, "__y") * F.count("*") for c in names)).alias("__c"),
    )
    kinds = dict(df.dtypes)
    out = "term string, estimate double, se double, identifiable boolean, n double, rank int, df double, rss double, tss double"
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    terms = ["intercept", *covariates]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            made = []
            for r in g.to_dict("records"):
                gram = np.zeros((p, p))
                for (i, j), v in zip(pairs, r["__g"], strict=True):
                    gram[i, j] = gram[j, i] = v
                n, mx = r["n"], np.array(r["__mx"], float)
                beta, var, ok, rank, rss = _solved(gram, np.array(r["__c"], float), r["__t"], n)
                free = n - rank - 1
                s2 = rss / free if free > 0 else np.nan
                use = ~np.isnan(beta)
                level = r["__m"] - float(beta[use] @ mx[use])
                # the intercept's variance needs the whole inverse of the solved part
                inv = np.linalg.pinv(gram[np.ix_(use, use)], hermitian=True) if use.any() else np.zeros((0, 0))
                base = 1 / n + float(mx[use] @ inv @ mx[use])
                est = np.concatenate([[level], np.where(ok, beta, np.nan)])
                se = np.sqrt(np.concatenate([[base], np.where(ok, var, np.nan)]) * s2)
                for t, e, s, good in zip(terms, est, se, [bool(ok.all()), *ok.tolist()], strict=True):
                    made.append({**{k: r[k] for k in keys}, "term": t, "estimate": e if good or t == "intercept" and ok.all() else np.nan, "se": s if good else np.nan, "identifiable": good, "n": n, "rank": rank, "df": free, "rss": rss, "tss": r["__t"]})
            yield pd.DataFrame(made, columns=[*keys, *(c.split()[0] for c in out.split(", "))])

    told = moments.mapInPandas(run, f"{head}, {out}" if keys else out)
    none = lambda c: F.when(~F.isnan(c), F.col(c))
    told = told.withColumns({"estimate": none("estimate"), "se": none("se")})
    r2 = F.when(F.col("tss") > 0, 1 - F.col("rss") / F.col("tss"))
    free = F.when(F.col("df") > 0, F.col("df"))
    told = told.withColumns({"t": F.when(F.col("se") > 0, F.col("estimate") / F.col("se")), "r2": r2})
    told = told.withColumns({"adj_r2": 1 - (1 - F.col("r2")) * (F.col("n") - 1) / free, "f": F.when((F.col("rank") > 0) & (F.col("rss") > 0), (F.col("tss") - F.col("rss")) / F.col("rank") / (F.col("rss") / free)), "bic": F.when(F.col("rss") > 0, F.col("n") * F.log(F.col("rss") / F.col("n")) + (F.col("rank") + 1) * F.log("n"))})
    return told.withColumns({"pval": D.p_student(F.col("t"), free), "f_pval": D.p_f(F.col("f"), F.when(F.col("f").isNotNull(), F.col("rank").cast("double")), free)}).drop("rss", "tss")


def residualised(df: DataFrame, keys: Sequence[str], y: str, covariates: Sequence[str], name: str = "residual") -> DataFrame:
    """y less what the covariates explain within keys, plus its mean; rows with a null in any of them keep a null. Covariates that cannot be told apart are taken out all the same, as their span is."""
    fit = regression(df, keys, y, covariates)
    if fit.where("not identifiable").isEmpty():
        slopes = fit.where("term <> 'intercept'").groupBy(*keys).pivot("term", list(covariates)).agg(F.first("estimate"))
        mean = df.where(" and ".join(f"`{c}` is not null" for c in (y, *covariates))).groupBy(*keys).agg(*(F.avg(c).alias(f"__m{i}") for i, c in enumerate(covariates)))
        told = slopes.join(mean, list(keys)) if keys else slopes.crossJoin(F.broadcast(mean))
        told = told.select(*keys, *(F.col(f"`{c}`").alias(f"__b{i}") for i, c in enumerate(covariates)), *(f"__m{i}" for i in range(len(covariates))))
        joined = df.join(told, list(keys), "left") if keys else df.crossJoin(F.broadcast(told))
        fitted = sum((F.col(f"__b{i}") * (F.col(f"`{c}`") - F.col(f"__m{i}")) for i, c in enumerate(covariates)), F.lit(0.0))
        return joined.withColumn(name, F.col(f"`{y}`") - fitted).drop(*(f"__{s}{i}" for i in range(len(covariates)) for s in "bm"))
    raise ValueError("covariates are combinations of each other in some group")


def combat(df: DataFrame, samples: DataFrame, gene: str = "gene", sample: str = "sample", batch: str = "batch", value: str = "value", covariates: Sequence[str] = (), rounds: int = 500, tol: float = 1e-8) -> DataFrame:
    """Rows (gene, sample, corrected): location and scale of each batch moved to that of all, by empirical Bayes over all genes; what the covariates explain is kept.

    samples: one row each with its batch and string or numeric covariates; every gene has one value for each sample (a missing one is an error). Genes are standardised by a fit on batches and
    covariates. A batch's shifts over all genes give it a normal prior, its variances an inverse gamma one, both from moments that Spark aggregates; each gene's batch effect is the fixed point of the two
    posterior means. A batch of one sample has its shift corrected and keeps its scale; a gene without variance is left as it is. A level of a string covariate that some batch doesn't have at all
    is an error, as then the two can't be told apart, and so is a model without full rank. One batch leaves the values as they are. No rows give no rows.
    """
    meta = samples.select(sample, batch, *covariates).limit(MOST_SAMPLES + 1).toPandas()
    if len(meta) > MOST_SAMPLES or meta[sample].duplicated().any() or meta.isna().any(axis=None):
        raise ValueError(f"samples need one row each, without nulls, {MOST_SAMPLES} at most")
    meta = meta.sort_values(sample, ignore_index=True)
    codes, labels = pd.factorize(meta[batch], sort=True)
    columns = [(codes == i).astype(float) for i in range(len(labels))]
    for c in covariates:
        v = meta[c]
        if pd.api.types.is_numeric_dtype(v) or pd.api.types.is_bool_dtype(v):
            columns.append(v.to_numpy(float))
            continue
        if (pd.crosstab(meta[batch], v) == 0).any(axis=None):
            raise ValueError(f"a batch has no sample of some level of {c}")
        columns += [(v == level).to_numpy(float) for level in sorted(v.unique())[1:]]
    x, n_batch, n = np.column_stack(columns), len(labels), len(meta)
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("batches and covariates are confounded")
    place = {s: i for i, s in enumerate(meta[sample])}
    size = np.bincount(codes, minlength=n_batch).astype(float)
    kinds = dict(df.dtypes)
    own = df.join(F.broadcast(samples.select(sample)), sample, "left_semi") if n <= 1000 else df.join(samples.select(sample), sample, "left_semi")
    blocks = max(1, df.select(gene).distinct().count() * n // (1 << 21))
    rows = own.groupBy(gene, sample).agg(F.avg(value).cast("double").alias("count"), F.count(value).alias("k")).withColumn("block", F.pmod(F.xxhash64(gene), F.lit(blocks)))

    def standard(g: pd.DataFrame) -> tuple:
        genes, y = _matrix(g, gene, sample, place)
        if len(g) != y.size or (g.k != 1).any():
            raise ValueError("a gene needs exactly one value for each sample")
        beta = np.linalg.lstsq(x, y.T, rcond=None)[0]
        level = (size / n) @ beta[:n_batch]
        spread = np.sqrt(((y - (x @ beta).T) ** 2).mean(1))
        spread = np.where(spread > 1e-12 * np.maximum(np.abs(level), 1.0), spread, 0.0)
        base = level[:, None] + (x[:, n_batch:] @ beta[n_batch:]).T
        z = (y - base) / np.where(spread > 0, spread, 1.0)[:, None]
        shift = np.stack([z[:, codes == i].mean(1) for i in range(n_batch)])
        scale = np.stack([z[:, codes == i].var(1, ddof=1) if size[i] > 1 else np.ones(len(y)) for i in range(n_batch)])
        return genes, y, base, spread, z, shift, scale

    def first(g: pd.DataFrame) -> pd.DataFrame:
        _, _, _, spread, _, shift, scale = standard(g)
        use = spread > 0
        return pd.DataFrame([{"b": i, "g": a, "d": b} for i in range(n_batch) for a, b in zip(shift[i][use], scale[i][use], strict=True)], columns=["b", "g", "d"])

    told = rows.groupBy("block").applyInPandas(first, "b int, g double, d double").groupBy("b").agg(F.avg("g").alias("g"), F.var_samp("g").alias("t"), F.avg("d").alias("m"), F.var_samp("d").alias("v"))
    prior = {r.b: r for r in told.collect()}  # one row for each batch

    def second(g: pd.DataFrame) -> pd.DataFrame:
        genes, y, base, spread, z, shift, scale = standard(g)
        out = y.copy()
        for i in range(n_batch if n_batch > 1 else 0):
            at = codes == i
            p = prior.get(i)
            if p is None or not (spread > 0).any():
                continue
            t2 = p.t or 0.0
            a, d = shift[i].copy(), scale[i].copy()
            k = size[i]
            var = p.v or 0.0
            for _ in range(rounds):
                new = (t2 * k * shift[i] + d * p.g) / (t2 * k + d) if t2 > 0 else np.full(len(y), p.g)
                if k > 1 and var > 0:
                    lam, theta = (2 * var + p.m**2) / var, (p.m * var + p.m**3) / var
                    wide = (0.5 * ((z[:, at] - new[:, None]) ** 2).sum(1) + theta) / (k / 2 + lam - 1)
                else:
                    wide = np.full(len(y), p.m) if k > 1 else d
                done = max(np.abs(new - a).max(), np.abs(wide - d).max()) < tol
                a, d = new, wide
                if done:
                    break
            moved = (z[:, at] - a[:, None]) / np.sqrt(d)[:, None] * spread[:, None] + base[:, at]
            out[:, at] = np.where((spread > 0)[:, None], moved, y[:, at])
        return pd.DataFrame({gene: np.repeat(genes, n), sample: np.tile(meta[sample].to_numpy(), len(genes)), "corrected": out.ravel()})

    return rows.groupBy("block").applyInPandas(second, f"`{gene}` {kinds[gene]}, `{sample}` {kinds[sample]}, corrected double")
