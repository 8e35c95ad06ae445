"""Statistical tests. Data is aggregated to moments or counts by Spark; distribution tails are taken over the few aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.operators.lineage import numbered
from larkspan.operators.windows import average_rank


def two_groups(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """Count, mean and sample variance on each side of a condition, in one aggregation."""
    a, b = F.when(first, F.col(value)), F.when(~first, F.col(value))
    return df.groupBy(*keys).agg(F.count(a).alias("n1"), F.avg(a).alias("m1"), F.var_samp(a).alias("v1"), F.count(b).alias("n2"), F.avg(b).alias("m2"), F.var_samp(b).alias("v2"))


def welch(df: DataFrame, keys: Sequence[str], value: str, first: Column, p: bool = True) -> DataFrame:
    """Welch's t by group: lfc (difference of means), t, df, and the two-sided p."""
    s = two_groups(df, keys, value, first).where("n1 > 1 and n2 > 1 and v1 + v2 > 0")
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    out = s.withColumns({"lfc": F.col("m1") - F.col("m2"), "t": (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2), "df": (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))})
    return out.withColumn("pval", D.p_student(F.col("t"), F.col("df"))) if p else out


def pooled_t(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """Student's t with equal variances."""
    s = two_groups(df, keys, value, first).where("n1 > 1 and n2 > 1 and v1 + v2 > 0")
    dof = F.col("n1") + F.col("n2") - 2
    sp = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / dof
    out = s.withColumns({"t": (F.col("m1") - F.col("m2")) / F.sqrt(sp * (1 / F.col("n1") + 1 / F.col("n2"))), "df": dof.cast("double")})
    return out.withColumn("pval", D.p_student(F.col("t"), F.col("df")))


def chosen_t(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """Student's t where the ratio of rounded deviations is below 1.5, Welch's elsewhere."""
    a, b = welch(df, keys, value, first).select(*keys, F.col("t").alias("tw"), F.col("df").alias("dw"), "v1", "v2"), pooled_t(df, keys, value, first).select(*keys, F.col("t").alias("tp"), F.col("df").alias("dp"))
    s1, s2 = F.round(F.sqrt("v1"), 2), F.round(F.sqrt("v2"), 2)
    equal = F.greatest(s1, s2) < 1.5 * F.least(s1, s2)
    out = a.join(b, list(keys)).select(*keys, equal.alias("equal_var"), F.when(equal, F.col("tp")).otherwise(F.col("tw")).alias("t"), F.when(equal, F.col("dp")).otherwise(F.col("dw")).alias("df"))
    return out.withColumn("pval", D.p_student(F.col("t"), F.col("df")))


def moderated_t(df: DataFrame, keys: Sequence[str], value: str, first: Column, group: Sequence[str] = (), share: float = 0.1) -> DataFrame:
    """Difference over its standard error plus the ``share`` quantile of all standard errors of the group."""
    s = two_groups(df, [*group, *keys], value, first).where("n1 > 1 and n2 > 1")
    s = s.withColumn("se", F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")))
    base = s.groupBy(*group).agg(F.percentile("se", share).alias("s0"))
    out = s.join(base, list(group)) if group else s.crossJoin(F.broadcast(base))
    return out.withColumn("t", (F.col("m1") - F.col("m2")) / (F.col("se") + F.col("s0")))


def paired_t(df: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.count(difference).alias("n"), F.avg(difference).alias("mean"), F.stddev_samp(difference).alias("sd")).where("n > 1 and sd > 0")
    out = s.withColumns({"t": F.col("mean") / (F.col("sd") / F.sqrt("n")), "df": (F.col("n") - 1).cast("double")})
    return out.withColumn("pval", D.p_student(F.col("t"), F.col("df")))


def anova(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance from group sums."""
    g = df.dropna(subset=[value]).groupBy(*keys, group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    s = g.groupBy(*keys).agg(F.count("*").alias("__k"), F.sum("n").alias("all"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"), F.sum(F.col("n") * F.col("m")).alias("s"))
    between = F.col("sq") - F.col("s") * F.col("s") / F.col("all")
    d1, d2 = (F.col("__k") - 1).cast("double"), (F.col("all") - F.col("__k")).cast("double")
    out = s.where("__k > 1 and all > __k and within > 0").withColumns({"f": (between / d1) / (F.col("within") / d2), "df1": d1, "df2": d2})
    return out.select(*keys, "f", "df1", "df2").withColumn("pval", D.p_f(F.col("f"), F.col("df1"), F.col("df2")))


def levene(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Equality of variances: analysis of variance of distances to group medians."""
    m = df.groupBy(*keys, group).agg(F.median(value).alias("__m"))
    return anova(df.join(m, [*keys, group]).withColumn("__d", F.abs(F.col(value) - F.col("__m"))), keys, group, "__d")


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """U of the first side, with the tie- and continuity-corrected normal p, and the area under the curve."""
    r = average_rank(df.withColumn("__a", first.cast("int")).dropna(subset=[value]), keys, value, "__r")
    ties = r.groupBy(*keys, value).agg(F.count("*").cast("double").alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    s = r.groupBy(*keys).agg(F.sum("__a").cast("double").alias("n1"), F.sum(1 - F.col("__a")).cast("double").alias("n2"), F.sum(F.col("__a") * F.col("__r")).alias("w")).join(ties, list(keys)).where("n1 > 0 and n2 > 0")
    n, u = F.col("n1") + F.col("n2"), F.col("w") - F.col("n1") * (F.col("n1") + 1) / 2
    mid = F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("t") / (n * (n - 1))))
    out = s.select(*keys, u.alias("u"), (u / (F.col("n1") * F.col("n2"))).alias("auc"), F.when(sd > 0, F.greatest(F.abs(u - mid) - 0.5, F.lit(0.0)) / sd).alias("z"))
    return out.withColumn("pval", F.least(F.lit(1.0), D.p_normal_two_sided(F.col("z"))))


def kruskal(df: DataFrame, keys: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction."""
    r = average_rank(df.dropna(subset=[value]), keys, value, "__r")
    g = r.groupBy(*keys, group).agg(F.count("*").cast("double").alias("n"), F.sum("__r").alias("s"))
    ties = r.groupBy(*keys, value).agg(F.count("*").cast("double").alias("c")).groupBy(*keys).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"))
    s = g.groupBy(*keys).agg(F.count("*").alias("__k"), F.sum("n").alias("all"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q")).join(ties, list(keys)).where("__k > 1")
    n = F.col("all")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    out = s.select(*keys, h.alias("h"), (F.col("__k") - 1).cast("double").alias("df"))
    return out.withColumn("pval", D.p_chi2(F.col("h"), F.col("df")))


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    """Dunn's pairwise z on average ranks, with tie correction, over all pairs of groups."""
    r = average_rank(df.dropna(subset=[value]).withColumn("__k", F.lit(1)), ["__k"], value, "__r")
    g = r.groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg("__r").alias("m"))
    t = r.groupBy(value).agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("t"), F.sum("c").alias("all"))  # one row
    a, b = g.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma")), g.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    n = F.col("all")
    se = F.sqrt((n * (n + 1) / 12 - F.col("t") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb")))
    out = a.join(b, F.col("a") < F.col("b")).crossJoin(F.broadcast(t)).select("a", "b", ((F.col("ma") - F.col("mb")) / se).alias("z"))
    return out.withColumn("pval", D.p_normal_two_sided(F.col("z")))


def chi2_2x2(a: Column, b: Column, c: Column, d: Column, add: float = 5.0) -> Column:
    """Yates-corrected statistic of a 2 x 2 table; ``add`` goes to every cell where one is from 1 to 5."""
    small = F.exists(F.array(a, b, c, d), lambda x: (x > 0) & (x <= 5))
    a, b, c, d = (F.when(small, x + add).otherwise(x).cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    top = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    return F.try_divide(n * top * top, (a + b) * (c + d) * (a + c) * (b + d))


def contingency(df: DataFrame, a: str, b: str, pseudo: float = 0.0) -> DataFrame:
    """One row: chi-squared, degrees of freedom, Cramer's V and the least cell of a contingency table, empty cells included."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("c"))
    grid = cells.select(a).distinct().join(cells.select(b).distinct(), F.lit(True)).join(cells, [a, b], "left").select(a, b, (F.coalesce("c", F.lit(0)) + pseudo).alias("o"), F.coalesce("c", F.lit(0)).alias("c"))
    rows, cols = grid.groupBy(a).agg(F.sum("o").alias("r")), grid.groupBy(b).agg(F.sum("o").alias("s"))
    n = grid.agg(F.sum("o").alias("n"))
    e = F.col("r") * F.col("s") / F.col("n")
    s = grid.join(rows, a).join(cols, b).crossJoin(F.broadcast(n)).agg(F.sum((F.col("o") - e) * (F.col("o") - e) / e).alias("chi2"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb"), F.first("n").alias("n"), F.min("c").alias("least"))
    v = F.sqrt(F.col("chi2") / (F.col("n") * (F.least("ka", "kb") - 1)))
    return s.select("chi2", ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("df"), v.alias("cramers_v"), "least")


def confounding(df: DataFrame, batch: str, group: str) -> DataFrame:
    """How far batch and group are confounded: "confounded" with an empty cell, "partial" below 5 or with V over 0.7, else "ok"."""
    t = contingency(df, batch, group, 0.5)
    return t.withColumn("verdict", F.when(F.col("least") == 0, "confounded").when((F.col("least") < 5) | (F.col("cramers_v") > 0.7), "partial").otherwise("ok"))


def fisher_exact(df: DataFrame, keys: Sequence[str], row: Column, col: Column) -> DataFrame:
    """Fisher's exact test of two conditions within keys: cells a (both), b (row only), c (column only), d (neither), the odds ratio and the two-sided p. Rows where a condition is null are left out."""
    n = lambda r, c: F.count_if((row if r else ~row) & (col if c else ~col))
    t = df.groupBy(*keys).agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    odds = F.try_divide(F.col("a") * F.col("d"), (F.col("b") * F.col("c")).cast("double"))
    return t.withColumns({"odds_ratio": odds, "pval": D.p_fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d"))})


def shapiro(df: DataFrame, keys: Sequence[str], value: str, most: int = 5000) -> DataFrame:
    """Shapiro and Wilk's test by group: n, w, pval. Sizes that the method isn't made for, below 3 and above 5,000, and groups of one value have null; groups that are too large aren't gathered. Nulls and NaN are left out."""
    use = df.select(*keys, F.col(value).cast("double").alias("__v")).where("__v is not null and not isnan(__v)")
    sizes = use.groupBy(*keys).agg(F.count("*").alias("n"))
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        w, p = D.shapiro_wilk(np.sort(g["__v"].to_numpy(float)))
        return pd.DataFrame({**{k: [g[k].iloc[0]] for k in keys}, "w": [w], "pval": [p]})

    fit = use.join(sizes.where((F.col("n") >= 3) & (F.col("n") <= most)), list(keys), "left_semi").groupBy(*keys).applyInPandas(run, f"{head}, w double, pval double")
    out = sizes.join(fit, list(keys), "left")
    return out.select(*keys, "n", F.when(~F.isnan("w"), F.col("w")).alias("w"), F.when(~F.isnan("pval"), F.col("pval")).alias("pval"))


def dunnett(df: DataFrame, keys: Sequence[str], group: str, value: str, control) -> DataFrame:
    """Each group against the control within keys: rows (keys, group, difference, t, df, pval), pval adjusted for the number of comparisons. Groups without a value, keys without a control or without residual degrees of freedom have no
    rows. Groups are aggregated to their moments; a key's are one row."""
    s = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count(value).cast("double").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    packed = s.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(group).cast("string").alias("g"), "n", "m", "v"))).alias("all"))
    kinds = dict(df.dtypes)
    head = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    name = str(control)

    def run(batches):
        for b in batches:
            made = []
            for r in b.to_dict("records"):
                base = next((x for x in r["all"] if x["g"] == name), None)
                rest = [x for x in r["all"] if x["g"] != name and x["g"] is not None]
                free = sum(x["n"] for x in r["all"]) - len(r["all"])
                if base is None or not rest or free <= 0:
                    continue
                s2 = sum(x["n"] * x["v"] for x in r["all"]) / free
                shares = np.array([x["n"] / (x["n"] + base["n"]) for x in rest])
                for x in rest:
                    se = math.sqrt(s2 * (1 / x["n"] + 1 / base["n"]))
                    t = (x["m"] - base["m"]) / se if se > 0 else math.nan
                    made.append({**{k: r[k] for k in keys}, "g": x["g"], "difference": x["m"] - base["m"], "t": t, "df": free, "pval": D.dunnett_two_sided(t, shares, free) if se > 0 else math.nan})
            yield pd.DataFrame(made, columns=[*keys, "g", "difference", "t", "df", "pval"])

    out = packed.mapInPandas(run, f"{head}g string, difference double, t double, df double, pval double")
    return out.select(*keys, F.col("g").cast(kinds[group]).alias(group), "difference", F.when(~F.isnan("t"), F.col("t")).alias("t"), "df", F.when(~F.isnan("pval"), F.col("pval")).alias("pval"))


def fisher_meta(df: DataFrame, keys: Sequence[str], r: str, n: str) -> DataFrame:
    """Fixed-effect mean of correlations by Fisher's z, Cochran's Q and I squared."""
    w = F.col(n) - 3
    z = F.atanh(F.greatest(F.least(F.col(r), F.lit(0.999999)), F.lit(-0.999999)))
    s = df.where(w > 0).groupBy(*keys).agg(F.count("*").alias("k"), F.sum(w).alias("w"), F.sum(w * z).alias("wz"), F.sum(w * z * z).alias("wzz"))
    mean = F.col("wz") / F.col("w")
    q = F.col("wzz") - F.col("wz") * mean
    out = s.select(*keys, "k", F.tanh(mean).alias("r_meta"), (mean * F.sqrt("w")).alias("z_meta"), q.alias("q"), F.when(q > 0, F.greatest((q - (F.col("k") - 1)) / q, F.lit(0.0))).otherwise(0.0).alias("i2"))
    return out.withColumn("pval", D.p_normal_two_sided(F.col("z_meta")))


def mean_interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Confidence interval of the mean: Student quantile times the population deviation over the root of n."""
    s = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).where("n > 1")
    half = D.t_quantile((1 + level) / 2, (F.col("n") - 1).cast("double")) * F.col("sd") / F.sqrt("n")
    return s.withColumn("half", half).withColumns({"low": F.col("mean") - F.col("half"), "high": F.col("mean") + F.col("half")})


def product_error(values: Sequence[tuple[Column, Column]], result: Column) -> Column:
    """Error of a product or quotient from its factors and their errors."""
    return F.abs(result) * F.sqrt(sum(((e / v) * (e / v) for v, e in values), F.lit(0.0)))


def bimodality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bimodality coefficient from population skewness and excess kurtosis."""
    s = df.groupBy(*keys).agg(F.count(value).cast("double").alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt")).where("n > 3")
    n = F.col("n")
    return s.withColumn("bc", (F.col("skew") * F.col("skew") + 1) / (F.col("kurt") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))))


def simple_regression(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Least squares on one predictor: slope, intercept, R squared and its adjusted form, F."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))
    n = F.col("n")
    return s.where("n > 2").withColumns({"adj_r2": 1 - (1 - F.col("r2")) * (n - 1) / (n - 2), "f": F.col("r2") * (n - 2) / (1 - F.col("r2"))})


def residuals(df: DataFrame, keys: Sequence[str], y: str, x: str, name: str = "residual") -> DataFrame:
    """y less its fit on x, plus its mean."""
    s = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"), F.avg(y).alias("__m"))
    return df.join(s, list(keys)).withColumn(name, F.col(y) - F.col("__a") - F.col("__b") * F.col(x) + F.col("__m")).drop("__a", "__b", "__m")


def factorial_ols(df: DataFrame, keys: Sequence[str], y: str, a: str, b: str) -> DataFrame:
    """y on two 0/1 factors and their product by group, from the four cells' moments: estimate, t and p of each term.

    The design is saturated, so the estimates are differences of cell means and the residual variance is the pooled within-cell variance.
    """
    cell = lambda i, j: (F.col(a) == i) & (F.col(b) == j)
    aggs = [g for i in (0, 1) for j in (0, 1) for g in (F.count(F.when(cell(i, j), F.col(y))).alias(f"n{i}{j}"), F.avg(F.when(cell(i, j), F.col(y))).alias(f"m{i}{j}"), F.var_pop(F.when(cell(i, j), F.col(y))).alias(f"v{i}{j}"))]
    s = df.groupBy(*keys).agg(*aggs).where("n00 > 0 and n01 > 0 and n10 > 0 and n11 > 0 and n00 + n01 + n10 + n11 > 4")
    n = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    rss = sum((F.col(f"n{c}") * F.col(f"v{c}") for c in ("00", "01", "10", "11")), F.lit(0.0))
    s = s.withColumns({"df": (n - 4).cast("double"), "__s2": rss / (n - 4)})
    m = {c: F.col(f"m{c}") for c in ("00", "01", "10", "11")}
    u = {c: 1 / F.col(f"n{c}") for c in m}
    terms = [("a", m["10"] - m["00"], u["10"] + u["00"]), ("b", m["01"] - m["00"], u["01"] + u["00"]), ("ab", m["11"] - m["10"] - m["01"] + m["00"], u["00"] + u["01"] + u["10"] + u["11"])]
    long = s.select(*keys, "df", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), e.alias("estimate"), (e / F.sqrt(F.col("__s2") * w)).alias("t")) for t, e, w in terms])).alias("x")).select(*keys, "df", "x.*")
    return long.withColumn("pval", D.p_student(F.col("t"), F.col("df")))


def jaccard_pairs(df: DataFrame, item: str, feature: str) -> DataFrame:
    """Similarity and distance of the feature sets of all pairs of items that share a feature.

    The join is on features; a pair that shares none has distance 1 and is left out, as there may be any number of them.
    """
    s = df.select(item, feature).distinct()
    sizes = s.groupBy(item).agg(F.count("*").alias("n"))
    a, b = s.select(F.col(item).alias("a"), feature), s.select(F.col(item).alias("b"), feature)
    both = a.join(b, feature).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = both.join(sizes.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    j = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return both.select("a", "b", "shared", j.alias("similarity"), (1 - j).alias("distance"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information of two labellings, from their contingency table."""
    c = df.groupBy(a, b).agg(F.count("*").cast("double").alias("c"))
    r, s = c.groupBy(a).agg(F.sum("c").alias("r")), c.groupBy(b).agg(F.sum("c").alias("s"))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    ent = lambda t, x: t.agg(F.sum(two(x)).alias(f"t{x}"), F.sum(F.col(x) * F.log(x)).alias(f"l{x}"))
    one = ent(c, "c").crossJoin(ent(r, "r")).crossJoin(ent(s, "s")).crossJoin(c.agg(F.sum("c").alias("n")))  # one row each
    n = F.col("n")
    expected = F.col("tr") * F.col("ts") / (n * (n - 1) / 2)
    ari = (F.col("tc") - expected) / ((F.col("tr") + F.col("ts")) / 2 - expected)
    ha, hb = F.log(n) - F.col("lr") / n, F.log(n) - F.col("ls") / n
    mi = F.log(n) + F.col("lc") / n - F.col("lr") / n - F.col("ls") / n
    return one.select(ari.alias("ari"), (mi / ((ha + hb) / 2)).alias("nmi"))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def size_factors(df: DataFrame, sample: str, gene: str, count: str) -> DataFrame:
    """Median-of-ratios factors over the genes that every sample has."""
    n = df.agg(F.count_distinct(sample).alias("n"))  # one row
    means = df.where(F.col(count) > 0).groupBy(gene).agg(F.count("*").alias("k"), F.avg(F.log(count)).alias("g")).crossJoin(F.broadcast(n)).where("k = n").select(gene, "g")
    return df.join(means, gene).groupBy(sample).agg(F.exp(F.median(F.log(count) - F.col("g"))).alias("size_factor"))


def expression_test(df: DataFrame, sample: str, gene: str, count: str, tumour: Column) -> DataFrame:
    """Welch's t on log2 of counts over size factors: a stand-in for count models, and named so in its method column."""
    x = df.join(size_factors(df, sample, gene, count), sample).withColumn("__y", F.log2(F.col(count) / F.col("size_factor") + 1))
    return welch(x, [gene], "__y", tumour).withColumn("method", F.lit("welch_log2_size_factors"))


def _permutations(units: DataFrame, unit: str, n: int, seed: int, name: str) -> DataFrame:
    """Rows (unit, perm, place) of n orders of the units by hashes; all orders are numbered in one range-partitioned sort, as each has as many places."""
    size = units.agg(F.count("*").alias("__all"))  # one row
    rows = units.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("__h", F.xxhash64(F.lit(seed), "perm", unit))
    told = numbered(rows, ["perm", "__h", unit], "__no").crossJoin(F.broadcast(size))
    return told.select(unit, "perm", (F.pmod(F.col("__no") - 1, F.col("__all")) + 1).alias(name))


def permutation_coupling(df: DataFrame, pairs: DataFrame, unit: str, feature: str, value: str, n: int = 200, seed: int = 5) -> DataFrame:
    """Spearman coupling of feature pairs (a, b), with p from n relabellings of the units, each a hash order.

    The permutations are a table (perm, unit, place): every one is another join key, so they run side by side.
    """
    units = df.select(unit).distinct()
    base = numbered(units, [unit], "place")
    perms = _permutations(units, unit, n, seed, "place")
    shuffled = perms.join(base.withColumnRenamed(unit, "__u"), "place").select("perm", unit, "__u").union(units.select(F.lit(0).alias("perm"), unit, F.col(unit).alias("__u")))
    r = average_rank(df, [feature], value, "__r").select(unit, feature, "__r")
    left = pairs.join(r.select(F.col(feature).alias("a"), unit, F.col("__r").alias("x")), "a")
    right = r.select(F.col(feature).alias("b"), F.col(unit).alias("__u"), F.col("__r").alias("y"))
    c = left.join(shuffled, unit).join(right, ["b", "__u"]).groupBy("a", "b", "perm").agg(F.corr("x", "y").alias("r"))
    own = c.where("perm = 0").select("a", "b", F.col("r").alias("rho"))
    return c.where("perm > 0").join(own, ["a", "b"]).groupBy("a", "b").agg(F.first("rho").alias("rho"), ((F.count_if(F.abs("r") >= F.abs("rho")) + 1) / (F.lit(n) + 1)).alias("pval"))


def permanova(df: DataFrame, unit: str, feature: str, value: str, group: DataFrame, n: int = 99, seed: int = 3) -> DataFrame:
    """Pseudo F, R squared and permutation p of groups on squared distances of units' profiles; group: (unit, label).

    Pair distances are one self join on the feature; permuted labels are a table beside them.
    """
    a, b = df.select(F.col(unit).alias("a"), feature, F.col(value).alias("x")), df.select(F.col(unit).alias("b"), feature, F.col(value).alias("y"))
    d2 = a.join(b, feature).where("a < b").groupBy("a", "b").agg(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y"))).alias("d2"))
    label = [c for c in group.columns if c != unit][0]
    own = group.select(unit, F.col(label).alias("g"))
    place = numbered(own, [unit], "i")
    perm = _permutations(own.select(unit), unit, n, seed, "i")
    labels = perm.join(place.select("i", "g"), "i").select("perm", unit, "g").union(own.select(F.lit(0).alias("perm"), unit, "g"))
    la, lb = labels.withColumnsRenamed({unit: "a", "g": "ga"}), labels.withColumnsRenamed({unit: "b", "g": "gb"})
    sizes = own.groupBy("g").agg(F.count("*").alias("m"))
    within = d2.join(la, "a").join(lb, ["perm", "b"]).where("ga = gb").join(sizes, F.col("ga") == sizes["g"]).groupBy("perm").agg(F.sum(F.col("d2") / F.col("m")).alias("ssw"))
    total = d2.agg(F.sum("d2").alias("t")).crossJoin(own.agg(F.count("*").alias("n_units"), F.count_distinct("g").alias("k")))  # one row each
    f = within.crossJoin(F.broadcast(total)).withColumn("sst", F.col("t") / F.col("n_units")).withColumn("f", ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n_units") - F.col("k"))))
    mine = f.where("perm = 0").select(F.col("f").alias("pseudo_f"), (1 - F.col("ssw") / F.col("sst")).alias("r2"))
    return f.where("perm > 0").crossJoin(F.broadcast(mine)).agg(F.first("pseudo_f").alias("pseudo_f"), F.first("r2").alias("r2"), ((F.count_if(F.col("f") >= F.col("pseudo_f")) + 1) / (F.lit(n) + 1)).alias("pval"))


def clr(df: DataFrame, unit: str, value: str, floor: float = 1e-6) -> DataFrame:
    """Centred log ratios of compositions."""
    logs = df.withColumn("__l", F.log(F.greatest(value, F.lit(floor))))
    return logs.join(logs.groupBy(unit).agg(F.avg("__l").alias("__m")), unit).withColumn("clr", F.col("__l") - F.col("__m")).drop("__l", "__m")


def bootstrap_spearman(df: DataFrame, keys: Sequence[str], id_col: str, a: str, b: str, n: int = 200, seed: int = 11) -> DataFrame:
    """Percentile interval of the rank correlation over n resamples; a resample's rows are picked by hashes, so it is the same on every run."""
    rows = numbered(df.dropna(subset=[a, b]), [*keys, id_col], "__no")
    size = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__no").alias("__first"))
    rows = rows.join(size.select(*keys, "__first"), list(keys)).withColumn("__i", (F.col("__no") - F.col("__first") + 1).cast("int"))
    size = size.drop("__first")
    picks = rows.select(*keys, "__i").join(size, list(keys)).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))
    picks = picks.select(*keys, "rep", (F.pmod(F.xxhash64(F.lit(seed), "rep", "__i"), F.col("__n")) + 1).cast("int").alias("__i"))
    drawn = picks.join(rows, [*keys, "__i"])
    r = average_rank(average_rank(drawn, [*keys, "rep"], a, "__a"), [*keys, "rep"], b, "__b").groupBy(*keys, "rep").agg(F.corr("__a", "__b").alias("r"))
    return r.groupBy(*keys).agg(F.percentile("r", 0.025).alias("low"), F.percentile("r", 0.5).alias("mid"), F.percentile("r", 0.975).alias("high"))


def batch_corrected(df: DataFrame, gene: str, sample: str, batch: str, value: str) -> DataFrame:
    """Location and scale of each batch moved to the gene's own, with batch effects shrunk over genes (empirical Bayes); one pandas group for each gene."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        y = x[value].to_numpy(float)
        codes, labels = pd.factorize(x[batch], sort=True)
        mean, sd = y.mean(), y.std()
        z = (y - mean) / sd if sd > 0 else y * 0
        g = np.array([z[codes == i].mean() for i in range(len(labels))])
        d = np.array([z[codes == i].var() if (codes == i).sum() > 1 else 1.0 for i in range(len(labels))])
        n = np.bincount(codes)
        g, d = g * n / (n + 1), (d * n + 1) / (n + 1)  # shrunk to no effect
        out = (z - g[codes]) / np.sqrt(np.maximum(d[codes], 1e-12))
        return pd.DataFrame({gene: x[gene], sample: x[sample], "corrected": out * sd + mean})

    kinds = dict(df.dtypes)
    return df.select(gene, sample, batch, value).groupBy(gene).applyInPandas(run, f"{gene} {kinds[gene]}, {sample} {kinds[sample]}, corrected double")
