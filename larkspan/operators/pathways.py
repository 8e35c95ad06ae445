"""Pathway indices and gene-set tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def modulation_index(genes: DataFrame, lfc: DataFrame, pathway: str, gene: str, value: str, min_lfc: float = 0.4, saturation: float = 3.0, mode: str = "linear_sat") -> DataFrame:
    """Up/down index of each pathway: log2 of the ratio of summed up- and down-regulation, whole and per gene, with the genes.

    genes: (pathway, gene); lfc: (gene, value). mode: "discrete" counts genes, "linear" sums values, "linear_sat" sums values clipped to the saturation. Where one side is 0, the
    saturation (whole) or half the least value (per gene) stands for it.
    """
    x = F.col(value)
    unit = {"discrete": F.signum(x), "linear": x, "linear_sat": F.greatest(F.least(x, F.lit(saturation)), F.lit(-saturation))}[mode]
    hit = genes.select(pathway, gene).distinct().join(lfc.select(gene, value), gene).where(F.abs(x) >= min_lfc)
    side = lambda c, up: F.when(x > 0 if up else x < 0, c)
    out = hit.groupBy(pathway).agg(
        F.coalesce(F.sum(side(unit, True)), F.lit(0.0)).alias("up"),
        F.coalesce(F.sum(side(F.abs(unit) if mode == "discrete" else unit, False)), F.lit(0.0)).alias("dw"),
        F.count(side(F.lit(1), True)).alias("n_up"),
        F.count(side(F.lit(1), False)).alias("n_dw"),
        F.array_sort(F.collect_list(side(F.col(gene), True))).alias("genes_up"),
        F.array_sort(F.collect_list(side(F.col(gene), False))).alias("genes_dw"),
    )
    up, dw = F.col("up"), F.col("dw")
    ratio = F.abs(F.when(dw == 0, up * saturation).when(up == 0, 1 / (saturation * dw)).otherwise(up / dw))
    un, dn = F.when(F.col("n_up") > 0, up / F.col("n_up")).otherwise(0.0), F.when(F.col("n_dw") > 0, dw / F.col("n_dw")).otherwise(0.0)
    half = min_lfc / 2
    per = F.abs(F.when(dn == 0, un / half).when(un == 0, half / dn).otherwise(un / dn))
    return out.withColumns({"ratio": ratio, "ppmi_total": F.when(ratio > 0, F.log2(ratio)), "ratio_norm": per, "ppmi_norm": F.when(per > 0, F.log2(per))})


def toi_scores(df: DataFrame, n_degs: str, n_genes: str, fdr: str, lfc_fdr: str) -> DataFrame:
    """The four trade-off scores of a pathway at a cutoff; toi3 and toi4 divide, as published, and the root forms come beside them."""
    ratio = F.col(n_degs) / F.col(n_genes)
    toi1 = F.sqrt(-F.log10(fdr) * ratio)
    toi2 = F.sqrt(F.log10(lfc_fdr) * F.log10(fdr))
    x3 = -F.log10(fdr) * -F.log10(lfc_fdr) * ratio
    x4 = x3 * F.col(n_degs)
    return df.withColumns({"ratio": ratio, "toi1": toi1, "toi2": toi2, "toi3": x3 / 3, "toi4": x4 / 4, "toi3_root": F.pow(x3, F.lit(1 / 3)), "toi4_root": F.pow(x4, F.lit(0.25))})


def toi_summary(df: DataFrame, keys: Sequence[str], scores: Sequence[str] = ("toi1", "toi2", "toi3", "toi4")) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_pathways"), *[f(s).alias(f"{s}_{n}") for s in scores for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_pop))])


_SMALL = 16


def log_factorial(n: Column) -> Column:
    """Of whole numbers from 0 on: by their products below 16, else by Stirling's series, which is exact to the last digits there."""
    x = n.cast("double") + 1
    u = 1 / (x * x)
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - u * (1 / 360 - u * (1 / 1260 - u / 1680))) / x
    small = F.element_at(F.array(*(F.lit(math.log(math.factorial(i))) for i in range(_SMALL))), F.least(n, F.lit(_SMALL - 1)).cast("int") + 1)
    return F.when(n < _SMALL, small).otherwise(series)


def hypergeometric_upper(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) of ``drawn`` from a population with ``marked``."""
    choose = lambda n, r: log_factorial(n) - log_factorial(r) - log_factorial(n - r)
    low, high = F.greatest(k, drawn + marked - population, F.lit(0)), F.least(marked, drawn)
    whole = choose(population, drawn)
    term = lambda i: F.exp(choose(marked, i) + choose(population - marked, drawn - i) - whole)
    total = F.aggregate(F.sequence(low.cast("long"), F.greatest(high, low).cast("long")), F.lit(0.0), lambda a, i: a + F.when(i <= high, term(i)).otherwise(0.0))
    return F.least(total, F.lit(1.0))


def enriched_sets(sets: DataFrame, chosen: DataFrame, universe: DataFrame, set_col: str, gene: str, least: int = 2) -> DataFrame:
    """Hypergeometric test of each gene set against chosen genes, within the universe; sets with fewer than ``least`` chosen genes go."""
    uni = universe.select(gene).distinct()
    sel = chosen.select(gene).distinct().join(uni, gene, "left_semi").withColumn("__s", F.lit(1))
    sizes = uni.agg(F.count("*").alias("population")).crossJoin(sel.agg(F.count("*").alias("drawn")))  # one row each
    per = sets.select(set_col, gene).distinct().join(uni, gene, "left_semi").join(sel, gene, "left").groupBy(set_col).agg(F.count("*").alias("marked"), F.count("__s").alias("k"))
    out = per.where(F.col("k") >= least).crossJoin(F.broadcast(sizes))
    return out.withColumn("pval", hypergeometric_upper(F.col("k"), F.col("population"), F.col("marked"), F.col("drawn")))


def gene_lists(df: DataFrame, keys: Sequence[str], gene: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_sort(F.collect_set(gene)).alias("genes"), F.count_distinct(gene).alias("n_genes"))


def top_labels(df: DataFrame, keys: Sequence[str], gene: str, value: str, n: int = 30) -> DataFrame:
    """The n genes of the largest |value|, by name, as "name (0.00)"."""
    from larkspan.operators.filters import top_per_group

    best = top_per_group(df, keys, [F.desc(F.abs(value)), F.col(gene)], n)
    return best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.format_string("%s (%.2f)", F.col(gene), F.col(value).cast("double")))).alias("labels"))


def best_quantile_row(df: DataFrame, keys: Sequence[str], score: str, tie: str, quantile: float, step: float = 0.05) -> DataFrame:
    """Within each group the best row whose score lies in the quantile bin (q, q + step]."""
    from larkspan.operators.filters import top_per_group

    edges = df.groupBy(*keys).agg(F.percentile(score, quantile).alias("__lo"), F.percentile(score, min(1.0, quantile + step)).alias("__hi"))
    inside = df.join(edges, list(keys)).where((F.col(score) > F.col("__lo")) & (F.col(score) <= F.col("__hi"))).drop("__lo", "__hi")
    return top_per_group(inside, keys, [F.desc(score), F.col(tie)], 1)
