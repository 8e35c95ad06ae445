"""Differential expression by count models: negative-binomial regression with shrunken dispersions, and weighted least squares with moderated variances.

Counts are long rows (gene, sample, count); a gene's missing samples count 0. Genes go through numpy kernels in blocks of a few hundred, chosen by hash, so that no task holds more than a block times the
samples. What all genes share (trends of dispersion or variance, priors) is found by Spark aggregations over one row for each gene, or for each of TREND_BINS bins, between two passes of the kernels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.operators.windows import fdr_bh

BLOCK_CELLS = 1 << 21  # genes times samples of a block, about
MOST_SAMPLES = 20_000  # the design goes with the kernels; more samples are refused
TREND_BINS = 400
RIDGE = 1e-6
LOG2 = math.log(2)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers, by Stirling's series from 10 on."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift -= np.where(low, np.log(x), 0.0)
        x = np.where(low, x + 1, x)
    u = 1 / (x * x)
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u * (1 / 1680 - u / 1188)))) / x


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out -= np.where(low, 1 / x, 0.0)
        x = np.where(low, x + 1, x)
    u = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - u * (1 / 12 - u * (1 / 120 - u * (1 / 252 - u * (1 / 240 - u / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        out += np.where(low, 1 / (x * x), 0.0)
        x = np.where(low, x + 1, x)
    u = 1 / (x * x)
    return out + (1 + 0.5 / x + u * (1 / 6 - u * (1 / 30 - u * (1 / 42 - u * (1 / 30 - u * 5 / 66))))) / x


def trigamma_inverse(y: float) -> float:
    """Where the trigamma function is y > 0, by bisection of the logarithm."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(trigamma(np.array(math.exp(mid)))) > y else (lo, mid)
    return math.exp((lo + hi) / 2)


class Design:
    """Samples in order and their model matrix: an intercept and the covariates, numbers as they are and strings as one column for each level but the first."""

    def __init__(self, samples: DataFrame, sample: str, covariates: Sequence[str]):
        rows = samples.select(sample, *covariates).limit(MOST_SAMPLES + 1).toPandas()
        if len(rows) > MOST_SAMPLES:
            raise ValueError(f"more than {MOST_SAMPLES} samples")
        if rows[sample].duplicated().any() or rows.isna().any(axis=None):
            raise ValueError("each sample needs one row without nulls")
        rows = rows.sort_values(sample, ignore_index=True)
        self.names, columns = ["intercept"], [np.ones(len(rows))]
        for c in covariates:
            v = rows[c]
            if pd.api.types.is_numeric_dtype(v) or pd.api.types.is_bool_dtype(v):
                self.names.append(c)
                columns.append(v.to_numpy(float))
                continue
            for level in sorted(v.unique())[1:]:
                self.names.append(f"{c}{level}")
                columns.append((v == level).to_numpy(float))
        self.place = {s: i for i, s in enumerate(rows[sample])}
        self.x = np.column_stack(columns)
        if np.linalg.matrix_rank(self.x) < self.x.shape[1]:
            raise ValueError("the covariates are confounded: the model matrix has not full rank")
        if len(rows) <= self.x.shape[1]:
            raise ValueError("no degrees of freedom: every sample needs a replicate of its kind somewhere")

    def index(self, term: str) -> int:
        return self.names.index(term)


def _blocks(counts: DataFrame, genes: DataFrame, sample: str, gene: str, count: str, n: int) -> DataFrame:
    """Rows of the counts with a block number, genes by hash. The block size follows the number of genes, one aggregated number."""
    blocks = max(1, genes.count() * n // BLOCK_CELLS)
    return counts.groupBy(gene, sample).agg(F.sum(count).cast("double").alias("count")).withColumn("block", F.pmod(F.xxhash64(gene), F.lit(blocks)))


def _matrix(g: pd.DataFrame, gene: str, sample: str, place: dict) -> tuple[np.ndarray, np.ndarray]:
    """Genes, in order, and their counts by sample."""
    codes, genes = pd.factorize(g[gene], sort=True)
    y = np.zeros((len(genes), len(place)))
    at = g[sample].map(place)
    ok = at.notna().to_numpy()
    y[codes[ok], at[ok].to_numpy(int)] = g["count"].to_numpy(float)[ok]
    return np.asarray(genes), y


# --- negative binomial


def _coefficients(y: np.ndarray, factors: np.ndarray, x: np.ndarray, alpha: np.ndarray, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By iteratively reweighted least squares with a slight ridge, all genes at once: coefficients (natural logarithms), fitted means, inverse information."""
    p = x.shape[1]
    ridge = RIDGE * np.eye(p)
    start = np.log(np.maximum(y / factors, 0.1))
    beta = np.linalg.solve(x.T @ x, x.T @ start.T).T
    live = np.arange(len(y))
    for _ in range(rounds):
        mu = np.maximum(factors * np.exp(np.clip(beta[live] @ x.T, -30, 30)), 1e-8)
        w = mu / (1 + alpha[live, None] * mu)
        z = np.log(mu / factors) + (y[live] - mu) / mu
        gram = np.einsum("gi,ij,ik->gjk", w, x, x) + ridge
        new = np.linalg.solve(gram, np.einsum("gi,ij->gj", w * z, x)[:, :, None])[:, :, 0]
        step = np.clip(new - beta[live], -4, 4)
        beta[live] += step
        live = live[np.abs(step).max(1) > tol]
        if not len(live):
            break
    mu = np.maximum(factors * np.exp(np.clip(beta @ x.T, -30, 30)), 1e-8)
    w = mu / (1 + alpha[:, None] * mu)
    gram = np.einsum("gi,ij,ik->gjk", w, x, x)
    inverse = np.linalg.inv(gram + ridge)
    return beta, mu, inverse @ gram @ inverse


def _profile(y: np.ndarray, mu: np.ndarray, x: np.ndarray, log_alpha: np.ndarray, centre: np.ndarray | None = None, width: float = 1.0) -> np.ndarray:
    """Cox-Reid adjusted log likelihood of each gene's dispersion at its fitted means, with a normal prior of log dispersion if a centre is given."""
    a = np.exp(log_alpha)[:, None]
    r = 1 / a
    ll = (lgamma(y + r) - lgamma(r) - lgamma(y + 1) + y * np.log(a * mu) - (y + r) * np.log1p(a * mu)).sum(1)
    w = mu / (1 + a * mu)
    ll -= 0.5 * np.linalg.slogdet(np.einsum("gi,ij,ik->gjk", w, x, x))[1]
    return ll if centre is None else ll - (log_alpha - centre) ** 2 / (2 * width)


def _dispersions(y: np.ndarray, mu: np.ndarray, x: np.ndarray, centre: np.ndarray | None = None, width: float = 1.0, low: float = 1e-8, high: float = 10.0) -> np.ndarray:
    """The log dispersion of the greatest profile: the best of a grid, then golden sections around it."""
    high = max(high, y.shape[1])
    grid = np.linspace(math.log(low), math.log(high), 40)
    values = np.stack([_profile(y, mu, x, np.full(len(y), g), centre, width) for g in grid])
    best = values.argmax(0)
    lo, hi = grid[np.maximum(best - 1, 0)], grid[np.minimum(best + 1, len(grid) - 1)]
    ratio = (math.sqrt(5) - 1) / 2
    a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
    fa, fb = _profile(y, mu, x, a, centre, width), _profile(y, mu, x, b, centre, width)
    for _ in range(60):
        left = fa >= fb
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
        a2, b2 = np.where(left, hi - ratio * (hi - lo), b), np.where(left, a, lo + ratio * (hi - lo))
        new = _profile(y, mu, x, np.where(left, a2, b2), centre, width)
        fa, fb = np.where(left, new, fb), np.where(left, fa, new)
        a, b = a2, b2
    return (lo + hi) / 2


def dispersion_trend(genes: DataFrame, rounds: int = 20) -> tuple[float, float]:
    """(a0, a1) of dispersion = a0 + a1 / mean over the rows (mean, dispersion), by gamma regression; each round is one aggregation of five sums. Genes far off the last curve are left out of the next round.

    Where no falling curve fits, or too few genes have a dispersion, the mean dispersion stands for all.
    """
    use = genes.where("dispersion > 1e-7 and mean > 0")
    a0, a1 = 0.1, 1.0
    for _ in range(rounds):
        fit = F.lit(a0) + F.lit(a1) / F.col("mean")
        ratio = F.col("dispersion") / fit
        w, u = 1 / (fit * fit), 1 / F.col("mean")
        s = use.where((ratio > 1e-4) & (ratio < 15)).agg(*(F.sum(c).alias(n) for n, c in (("w", w), ("u", w * u), ("uu", w * u * u), ("d", w * F.col("dispersion")), ("ud", w * u * F.col("dispersion"))))).first()
        det = (s.w or 0) * (s.uu or 0) - (s.u or 0) ** 2
        if not s.w or det <= 1e-12 * s.w * s.uu:
            break
        n0, n1 = (s.uu * s.d - s.u * s.ud) / det, (s.w * s.ud - s.u * s.d) / det
        if n0 <= 0 or n1 <= 0:
            break
        done = (math.log(n0 / a0)) ** 2 + (math.log(n1 / a1)) ** 2 < 1e-12
        a0, a1 = n0, n1
        if done:
            return a0, a1
    mean = use.agg(F.avg("dispersion")).first()[0]
    return (mean or 0.1), 0.0


def negative_binomial(counts: DataFrame, samples: DataFrame, term: str, covariates: Sequence[str], sample: str = "sample", gene: str = "gene", count: str = "count", factors: DataFrame | None = None, least: float = 10) -> DataFrame:
    """Negative-binomial regression of each gene on the covariates of its samples: gene, mean, log2_fold_change, lfc_se, stat, pvalue, padj, dispersion, dispersion_gene, dispersion_fit, method.

    counts: rows (gene, sample, count). samples: one row each with the covariates. term: the coefficient asked for, a numeric covariate's name or a string covariate's name and level. factors: rows
    (sample, size_factor); by default a sample's total over the geometric mean of the totals. A gene's own dispersion has the greatest Cox-Reid adjusted profile likelihood;
    a trend a0 + a1 / mean is fitted over all genes, and own dispersions are shrunk to it by a normal prior of their logarithms whose variance is that of the residuals less what sampling explains, 0.25 at
    least. A gene more than two deviations above the trend keeps its own. The statistic is Wald's.

    Genes with fewer than ``least`` counts in all, those without any included, have a mean and null for the rest. Samples without a factor or covariates are an error; a model without residual
    degrees of freedom (one sample a group) is refused. Negative counts are an error. No genes give no rows.
    """
    design = Design(samples, sample, covariates)
    column, place, x = design.index(term), design.place, design.x
    n, p = x.shape
    if factors is None:
        totals = counts.groupBy(sample).agg(F.sum(count).cast("double").alias("t")).where("t > 0")
        factors = totals.crossJoin(F.broadcast(totals.agg(F.exp(F.avg(F.log("t"))).alias("g")))).select(sample, (F.col("t") / F.col("g")).alias("size_factor"))  # one row beside each
    known = {r[0]: r[1] for r in factors.limit(MOST_SAMPLES + 1).collect()}
    if set(place) - set(known):
        raise ValueError("samples without a size factor")
    sf = np.array([known[s] for s in place])
    kind = dict(counts.dtypes)[gene]
    totals = counts.groupBy(gene).agg(F.sum(count).alias("all"), F.min(count).alias("low"))
    blocks = _blocks(counts, totals, sample, gene, count, n)

    def first(g: pd.DataFrame) -> pd.DataFrame:
        genes, y = _matrix(g, gene, sample, place)
        if (y < 0).any():
            raise ValueError("negative counts")
        mean, total = (y / sf).mean(1), y.sum(1)
        out = np.full(len(y), np.nan)
        use = total >= least
        if use.any():
            y = y[use]
            norm = y / sf
            guess = np.clip((norm.var(1, ddof=1) - norm.mean(1) * (1 / sf).mean()) / np.maximum(norm.mean(1), 1e-8) ** 2, 1e-4, 10)
            for _ in range(2):  # means at the guess, then at the estimate
                guess = np.exp(_dispersions(y, _coefficients(y, sf, x, guess)[1], x))
            out[use] = guess
        return pd.DataFrame({gene: genes, "mean": mean, "dispersion": out})

    own = blocks.groupBy("block").applyInPandas(first, f"`{gene}` {kind}, mean double, dispersion double").where("not isnan(dispersion)").persist()
    try:
        a0, a1 = dispersion_trend(own)
        centred = own.where("dispersion > 1e-7").select((F.log("dispersion") - F.log(F.lit(a0) + F.lit(a1) / F.col("mean"))).alias("r"))
        middle = centred.agg(F.median("r")).first()[0] or 0.0
        spread = (centred.agg(F.median(F.abs(F.col("r") - middle))).first()[0] or 0.0) * 1.4826
    finally:
        own.unpersist()
    width = max(spread**2 - float(trigamma(np.array((n - p) / 2))), 0.25)

    def second(g: pd.DataFrame) -> pd.DataFrame:
        names = first(g)
        _, y = _matrix(g, gene, sample, place)
        use = names.dispersion.notna().to_numpy()
        made = {c: np.full(len(y), np.nan) for c in ("lfc", "se", "fit", "final")}
        if use.any():
            y, gene_wise = y[use], names.dispersion.to_numpy()[use]
            fit = a0 + a1 / names["mean"].to_numpy()[use]
            mu = _coefficients(y, sf, x, gene_wise)[1]
            final = np.exp(_dispersions(y, mu, x, np.log(fit), width))
            outlier = np.log(gene_wise) > np.log(fit) + 2 * spread
            final = np.where(outlier & (spread > 0), gene_wise, final)
            beta, _, cov = _coefficients(y, sf, x, final)
            made["lfc"][use], made["se"][use] = beta[:, column] / LOG2, np.sqrt(cov[:, column, column]) / LOG2
            made["fit"][use], made["final"][use] = fit, final
        return pd.DataFrame({gene: names[gene], "mean": names["mean"], "log2_fold_change": made["lfc"], "lfc_se": made["se"], "dispersion": made["final"], "dispersion_gene": names.dispersion, "dispersion_fit": made["fit"]})

    doubles = ["mean", "log2_fold_change", "lfc_se", "dispersion", "dispersion_gene", "dispersion_fit"]
    fitted = blocks.groupBy("block").applyInPandas(second, f"`{gene}` {kind}, " + ", ".join(f"{c} double" for c in doubles))
    fitted = fitted.select(gene, *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in doubles)).withColumn("stat", F.col("log2_fold_change") / F.col("lfc_se"))
    tested = fdr_bh(fitted.where("stat is not null").withColumn("pvalue", D.p_normal_two_sided(F.col("stat"))), [], "pvalue", "padj")
    rest = fitted.where("stat is null").withColumns({"pvalue": F.lit(None).cast("double"), "padj": F.lit(None).cast("double")})
    return tested.unionByName(rest).withColumn("method", F.lit("negative_binomial_wald"))


# --- moderated least squares


def binned_lowess(points: DataFrame, x: str, y: str, share: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """A lowess curve of y on x as (places, values): local lines with tricube weights over the nearest ``share`` of the points.

    Points are aggregated to TREND_BINS bins of equal width first, each with its count and mean place and value, so one bounded aggregation is all that leaves Spark. The curve is read by linear interpolation.
    """
    ends = points.agg(F.min(x).alias("a"), F.max(x).alias("b")).first()
    if ends.a is None:
        return np.zeros(1), np.full(1, np.nan)
    width = max(ends.b - ends.a, 1e-12) / TREND_BINS
    bins = points.groupBy(F.least(F.floor((F.col(x) - F.lit(ends.a)) / F.lit(width)), F.lit(TREND_BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    rows = sorted((r.x, r.y, r.n) for r in bins.collect())  # TREND_BINS at most
    return lowess(*(np.array(v, float) for v in zip(*rows, strict=True)), share)


def lowess(at: np.ndarray, value: np.ndarray, weight: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    out = np.empty(len(at))
    for i, x in enumerate(at):
        d = np.abs(at - x)
        order = np.argsort(d, kind="stable")
        inside = order[: np.searchsorted(np.cumsum(weight[order]), share * weight.sum()) + 1]
        h = max(d[inside].max() * 1.0001, 1e-12)
        w = weight * np.clip(1 - (d / h) ** 3, 0, None) ** 3
        mx, my = (w * at).sum() / w.sum(), (w * value).sum() / w.sum()
        sxx = (w * (at - mx) ** 2).sum()
        out[i] = my + ((w * (at - mx) * (value - my)).sum() / sxx * (x - mx) if sxx > 1e-12 else 0.0)
    return at, out


def _weighted(y: np.ndarray, w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted least squares of each row: coefficients, unscaled variances, residual variance."""
    gram = np.einsum("gi,ij,ik->gjk", w, x, x)
    beta = np.linalg.solve(gram, np.einsum("gi,ij->gj", w * y, x)[:, :, None])[:, :, 0]
    variance = (w * (y - beta @ x.T) ** 2).sum(1) / (x.shape[0] - x.shape[1])
    return beta, np.diagonal(np.linalg.inv(gram), axis1=1, axis2=2), variance


def variance_prior(fits: DataFrame, df: int) -> tuple[float, float]:
    """(prior degrees of freedom, prior variance) by the moments of the logarithms of the rows' variance s2, each with df degrees of freedom; infinite if they vary no more than by sampling."""
    e = F.log("s2") - F.lit(float(digamma(np.array(df / 2))) - math.log(df / 2))
    m = fits.where("s2 > 0").select(e.alias("e"), F.coalesce(F.col("level"), F.lit(0.0)).alias("l")).agg(F.avg(F.col("e") - F.col("l")).alias("mean"), F.var_samp(F.col("e") - F.col("l")).alias("var")).first()
    if m["mean"] is None:
        return math.inf, 1.0
    left = (m["var"] or 0.0) - float(trigamma(np.array(df / 2)))
    if left <= 0:
        return math.inf, math.exp(m["mean"])
    d0 = 2 * trigamma_inverse(left)
    return d0, math.exp(m["mean"] + float(digamma(np.array(d0 / 2))) - math.log(d0 / 2))


def moderated(counts: DataFrame, samples: DataFrame, term: str, covariates: Sequence[str], sample: str = "sample", gene: str = "gene", count: str = "count", mode: str = "voom", prior_count: float = 0.5, already_log: bool = False, share: float = 0.5) -> DataFrame:
    """Least squares of each gene's log2 level on the covariates with variances moderated over all genes: gene, log2_fold_change, average, s2, unscaled, stat, df, pvalue, padj, method.

    mode "voom": levels are log2((count + 0.5) / (library + 1) * 1e6); the square root of the residual deviation is smoothed over the mean log2 count, and each observation gets the precision that the curve has at its
    fitted count. mode "trend": levels are log2(count + prior_count), or the values as they are if ``already_log``; the prior variance follows a curve over the average level. Prior degrees of
    freedom come from the moments of the log variances; the statistic is t with both. Genes whose variance is 0 have null statistics but don't enter the prior. A missing sample is a count of 0. Groups of one
    sample are refused where no degrees of freedom are left. No genes give no rows.
    """
    if mode not in ("voom", "trend"):
        raise ValueError(mode)
    design = Design(samples, sample, covariates)
    column, place, x = design.index(term), design.place, design.x
    df = x.shape[0] - x.shape[1]
    totals = {r[0]: float(r[1] or 0) for r in counts.groupBy(sample).agg(F.sum(count)).limit(MOST_SAMPLES + 1).collect()}
    library = np.array([totals.get(s, 0.0) for s in place])
    kind = dict(counts.dtypes)[gene]
    blocks = _blocks(counts, counts.select(gene).distinct(), sample, gene, count, x.shape[0])

    def level(y: np.ndarray) -> np.ndarray:
        return np.log2((y + 0.5) / (library + 1) * 1e6) if mode == "voom" else y if already_log else np.log2(y + prior_count)

    def fits(weigh: Callable[[np.ndarray], np.ndarray]):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            genes, y = _matrix(g, gene, sample, place)
            e = level(y)
            beta, unscaled, s2 = _weighted(e, weigh(e), x)
            return pd.DataFrame({gene: genes, "log2_fold_change": beta[:, column], "average": e.mean(1), "s2": np.where(s2 < 1e-20, 0.0, s2), "unscaled": unscaled[:, column]})

        return run

    schema = f"`{gene}` {kind}, log2_fold_change double, average double, s2 double, unscaled double"
    plain = blocks.groupBy("block").applyInPandas(fits(np.ones_like), schema)
    if mode == "voom":
        shift = float(np.log2(library + 1).mean() - math.log2(1e6))
        at, curve = binned_lowess(plain.where("s2 > 0").select((F.col("average") + F.lit(shift)).alias("x"), F.sqrt(F.sqrt("s2")).alias("y")), "x", "y", share)

        def weigh(e: np.ndarray) -> np.ndarray:
            beta = np.linalg.lstsq(x, e.T, rcond=None)[0]
            fitted = (beta.T @ x.T) + np.log2(library + 1) - math.log2(1e6)
            return 1 / np.maximum(np.interp(fitted, at, curve), 1e-4) ** 4

        told = blocks.groupBy("block").applyInPandas(fits(weigh), schema).withColumn("level", F.lit(0.0))
    else:
        at, curve = binned_lowess(plain.where("s2 > 0").select(F.col("average").alias("x"), F.log("s2").alias("y")), "x", "y", share)

        def read(v: pd.Series) -> pd.Series:
            return pd.Series(np.interp(v.to_numpy(float), at, curve))

        told = plain.withColumn("level", F.pandas_udf(read, "double")(F.col("average")))
    d0, s0 = variance_prior(told, df)
    prior = F.lit(s0) * F.exp("level")
    post = prior if math.isinf(d0) else (F.lit(d0) * prior + df * F.col("s2")) / F.lit(d0 + df)
    whole = min(d0 + df, 1e8)
    out = told.withColumn("stat", F.when(F.col("s2") > 0, F.col("log2_fold_change") / F.sqrt(post * F.col("unscaled")))).withColumns({"df": F.lit(float(whole)), "posterior_s2": post}).drop("level")
    tested = fdr_bh(out.where("stat is not null").withColumn("pvalue", D.p_student(F.col("stat"), F.col("df"))), [], "pvalue", "padj")
    rest = out.where("stat is null").withColumns({"pvalue": F.lit(None).cast("double"), "padj": F.lit(None).cast("double")})
    return tested.unionByName(rest).withColumn("method", F.lit(f"moderated_{mode}"))
