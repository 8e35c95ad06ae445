"""Count models, moderated statistics, regression, batch correction, density and consensus clustering, held-out signatures and factorisation."""

from pyspark.sql import functions as F

from larkspan.operators import consensus, deconvolution, density, expression, regression, stats, windows
from larkspan.operators.lineage import Steps
from larkspan.plans.registry import query, table


def _r(c, n=6):
    return F.round(c, n).alias(c)


def _expression(spark, sf):
    """Line items of each brand and type by the supplier's nation and year: rows (gene, sample, count), and the samples with east (0 or 1) and years."""
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.col("r_name").isin("ASIA", "EUROPE").cast("int").alias("east"))
    suppliers = table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    x = lines.select(F.concat_ws("/", "p_brand", "p_type").alias("gene"), F.concat_ws("-", "n_name", F.year("l_shipdate")).alias("sample"), "east", (F.year("l_shipdate") - 1995).alias("year"))
    return x.groupBy("gene", "sample").agg(F.count("*").alias("count")), x.select("sample", "east", "year").distinct()


@query("nb_regression")
def nb_regression(spark, sf):
    counts, samples = _expression(spark, sf)
    out = expression.negative_binomial(counts, samples, "east", ["east", "year"])
    return out.select("gene", _r("mean"), _r("log2_fold_change", 5), _r("lfc_se", 5), _r("stat", 4), _r("pvalue", 5), _r("padj", 5), F.round(F.log("dispersion"), 3).alias("log_dispersion"))


@query("voom")
def voom(spark, sf):
    counts, samples = _expression(spark, sf)
    return expression.moderated(counts, samples, "east", ["east", "year"]).select("gene", _r("log2_fold_change"), _r("average"), _r("stat", 5), _r("pvalue", 5), _r("padj", 5))


@query("moderated_trend")
def moderated_trend(spark, sf):
    counts, samples = _expression(spark, sf)
    return expression.moderated(counts, samples, "east", ["east", "year"], mode="trend").select("gene", _r("log2_fold_change"), _r("average"), _r("stat", 5), _r("pvalue", 5), _r("padj", 5))


@query("combat")
def combat(spark, sf):
    counts, samples = _expression(spark, sf)
    filled = counts.select("gene").distinct().select("gene", F.explode(F.array(*[F.lit(r[0]) for r in samples.select("sample").orderBy("sample").collect()])).alias("sample")).join(counts, ["gene", "sample"], "left")
    levels = filled.select("gene", "sample", F.log2(F.coalesce("count", F.lit(0)) + 1).alias("value"))
    batches = samples.select("sample", F.concat(F.lit("y"), "year").alias("batch"), F.when(F.col("east") == 1, "east").otherwise("other").alias("mode"))
    return regression.combat(levels, batches, covariates=["mode"]).select("gene", "sample", _r("corrected", 5))


_TWO = """WITH m AS (SELECT p_brand, count(*) n, avg(l_quantity) my, avg(l_discount) m1, avg(l_tax) m2, var_pop(l_quantity) vy, var_pop(l_discount) v1, var_pop(l_tax) v2,
  covar_pop(l_discount, l_tax) c12, covar_pop(l_discount, l_quantity) c1, covar_pop(l_tax, l_quantity) c2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
b AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) b2, v1 * v2 - c12 * c12 det FROM m),
s AS (SELECT *, n * (vy - b1 * c1 - b2 * c2) rss FROM b),
t AS (SELECT *, rss / (n - 3) s2, 1 - rss / (n * vy) r2 FROM s),
u AS (SELECT p_brand, n, rss, r2, unnest(['intercept', 'l_discount', 'l_tax']) term, unnest([my - b1 * m1 - b2 * m2, b1, b2]) estimate,
  unnest([sqrt(s2 * (1 / n + (m1 * m1 * v2 + m2 * m2 * v1 - 2 * m1 * m2 * c12) / (n * det))), sqrt(s2 * v2 / (n * det)), sqrt(s2 * v1 / (n * det))]) se FROM t)
SELECT p_brand, term, round(estimate, 5) estimate, round(se, 5) se, round(estimate / se, 5) t, round(r2, 7) r2, round(1 - (1 - r2) * (n - 1) / (n - 3), 7) adj_r2, round(n * ln(rss / n) + 3 * ln(n), 4) bic, true identifiable FROM u"""


@query("regression_two", _TWO)
def regression_two(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = regression.regression(lines, ["p_brand"], "l_quantity", ["l_discount", "l_tax"])
    return out.select("p_brand", "term", _r("estimate", 5), _r("se", 5), _r("t", 5), _r("r2", 7), _r("adj_r2", 7), _r("bic", 4), "identifiable")


@query("fraction_regression")
def fraction_regression(spark, sf):
    """Each part type's level on the share of a segment among a month's orders, that share by case (an odd year), and the case."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    shares = orders.groupBy("month").agg(F.avg((F.col("c_mktsegment") == "BUILDING").cast("double")).alias("theta"), F.max(F.year("o_orderdate") % 2).alias("case"))
    levels = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(orders.select("o_orderkey", "month"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("p_brand", "month").agg(F.log2(F.sum("l_quantity").cast("double") + 1).alias("level"))
    rows = levels.join(shares, "month").withColumn("theta_case", F.col("theta") * F.col("case"))
    out = regression.regression(rows, ["p_brand"], "level", ["theta", "case", "theta_case"])
    return out.select("p_brand", "term", _r("estimate", 5), _r("se", 5), _r("t", 4), _r("pval", 5), "identifiable")


@query("residualised_two", """WITH m AS (SELECT p_brand, avg(l_quantity) my, avg(l_discount) m1, avg(l_tax) m2, var_pop(l_discount) v1, var_pop(l_tax) v2, covar_pop(l_discount, l_tax) c12, covar_pop(l_discount, l_quantity) c1, covar_pop(l_tax, l_quantity) c2
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT p_brand, round(min(r), 5) low, round(max(r), 5) high, round(avg(r), 5) mean FROM (SELECT p_brand, l_quantity - (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) * (l_discount - m1) - (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) * (l_tax - m2) r
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN m USING (p_brand)) GROUP BY 1""")
def residualised_two(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    r = regression.residualised(lines, ["p_brand"], "l_quantity", ["l_discount", "l_tax"])
    return r.groupBy("p_brand").agg(F.round(F.min("residual"), 5).alias("low"), F.round(F.max("residual"), 5).alias("high"), F.round(F.avg("residual"), 5).alias("mean"))


@query("hdbscan")
def hdbscan(spark, sf):
    return density.hdbscan(table(spark, sf, "embeddings"), "vec_id", "embedding", 4, 5)


@query("consensus_k")
def consensus_k(spark, sf):
    out = consensus.consensus(table(spark, sf, "embeddings"), "vec_id", "embedding", range(2, 7), 20, min_fraction=0.02)
    return out.select("k", _r("pac"), _r("smallest"), "n_landmarks", "chosen", F.round(F.element_at("cdf", 51), 6).alias("cdf_half"))


@query("heldout_signatures")
def heldout_signatures(spark, sf):
    """Features that tell clusters of vectors apart, the clusters named after a side of the first coordinate."""
    e = table(spark, sf, "embeddings")
    side = e.select("vec_id", F.when(F.element_at("embedding", 1) > 0, "right").otherwise("left").alias("side"))
    out = consensus.heldout_signatures(e, "vec_id", "embedding", 2, 10, reference=side)
    return out.select("cluster", "feature", _r("median_p"), _r("fdr_of_median"), _r("frac_splits_sig"), _r("mean_lfc"), "n_splits_tested")


@query("factorised_profiles")
def factorised_profiles(spark, sf):
    """Brands' line items by month as two parts: each brand's share of the first, which is the one that the brands have most of."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    counts = lines.groupBy("p_brand", F.month("l_shipdate").alias("m")).agg(F.count("*").cast("double").alias("n"))
    x = counts.groupBy("p_brand").agg(F.map_from_entries(F.collect_list(F.struct("m", "n"))).alias("by")).select("p_brand", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(F.try_element_at("by", m), F.lit(0.0))).alias("x"))
    w, h, _ = consensus.factorised(x, "p_brand", "x", 2, rounds=12)
    mass = F.transform(F.arrays_zip("weights", F.array(*(F.lit(float(v)) for v in h.sum(1))).alias("s")), lambda z: z["weights"] * z["s"])
    return w.select("p_brand", F.round(F.array_max(mass) / F.aggregate(mass, F.lit(0.0), lambda a, v: a + v), 4).alias("largest_share"))


def _mixture(spark, sf):
    """Quantities by supplier and part class, the profiles of three sizes of parts, and equal fractions. All of them are sums of one small table, which is made and written once."""
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("gene"), F.concat(F.lit("s"), F.col("p_size") % 3).alias("state"))
    own = table(spark, sf, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 20).alias("sample")).agg(F.sum("l_quantity").alias("q"))
    cells = own.join(parts.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))  # not by a broadcast of all parts
    cells = Steps(spark).write(cells.groupBy("sample", "gene", "state").agg(F.sum("q").alias("q")))
    bulk = cells.groupBy("sample", "gene").agg(F.sum("q").alias("count"))
    phi = deconvolution.profiles(cells.groupBy("state", "gene").agg((F.sum("q") + 1).alias("level")))
    theta = cells.groupBy("sample", "state").agg(F.sum("q").alias("q")).join(cells.groupBy("sample").agg(F.sum("q").alias("t")), "sample").select("sample", "state", (F.col("q") / F.col("t")).alias("theta"))
    return bulk, theta, phi


_Z = """l AS (SELECT l_suppkey % 20 s, p_brand || '/' || p_type g, 's' || (p_size % 3) k, l_quantity q FROM lineitem JOIN part ON l_partkey = p_partkey),
b AS (SELECT s, g, sum(q) c FROM l GROUP BY 1, 2), h AS (SELECT k, g, sum(q) + 1 v FROM l GROUP BY 1, 2), w AS (SELECT kk.k, gg.g, coalesce(v, 0) + 1e-9 v FROM (SELECT DISTINCT k FROM h) kk CROSS JOIN (SELECT DISTINCT g FROM h) gg LEFT JOIN h ON h.k = kk.k AND h.g = gg.g),
f AS (SELECT k, g, v / sum(v) OVER (PARTITION BY k) phi FROM w), t AS (SELECT s, k, sum(q) / sum(sum(q)) OVER (PARTITION BY s) theta FROM l GROUP BY 1, 2),
z AS (SELECT b.s, f.k, b.g, c * theta * phi / sum(theta * phi) OVER (PARTITION BY b.s, b.g) z FROM b JOIN f USING (g) JOIN t ON t.s = b.s AND t.k = f.k)"""


@query("expected_counts", f"WITH {_Z} SELECT s sample, k state, round(sum(z), 4) total, round(max(z), 4) most FROM z GROUP BY 1, 2")
def expected_counts(spark, sf):
    z = deconvolution.expected_counts(*_mixture(spark, sf))
    return z.groupBy("sample", "state").agg(F.round(F.sum("z"), 4).alias("total"), F.round(F.max("z"), 4).alias("most"))


@query("updated_reference", f"WITH {_Z}, m AS (SELECT s, g, sum(z) z FROM z WHERE k = 's0' GROUP BY 1, 2), e AS (SELECT g, sum(z) z FROM z WHERE k <> 's0' GROUP BY 1), p AS (SELECT s, g, z / sum(z) OVER (PARTITION BY s) psi FROM m), r AS (SELECT g, z / sum(z) OVER () psi FROM e) SELECT g gene, round(r.psi, 7) rest, round(avg(p.psi), 7) malignant FROM r JOIN p USING (g) GROUP BY 1, 2")
def updated_reference(spark, sf):
    mal, env = deconvolution.updated_reference(deconvolution.expected_counts(*_mixture(spark, sf)), ["s0"])
    return env.withColumnRenamed("psi", "rest").join(mal.groupBy("gene").agg(F.avg("psi").alias("malignant")), "gene").select("gene", F.round("rest", 7).alias("rest"), F.round("malignant", 7).alias("malignant"))


@query("refitted_purity")
def refitted_purity(spark, sf):
    bulk, theta, phi = _mixture(spark, sf)
    out = deconvolution.refitted(bulk, *deconvolution.updated_reference(deconvolution.expected_counts(bulk, theta, phi), ["s0"]))
    return out.withColumn("purity", F.round("purity", 5))


@query("nnls_fractions")
def nnls_fractions(spark, sf):
    bulk, _, phi = _mixture(spark, sf)
    return deconvolution.nnls_fractions(bulk, phi).withColumn("weight", F.round("weight", 3))


@query("correlation_matrix", "WITH s AS (SELECT p_brand f, l_suppkey u, avg(l_quantity) v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) SELECT a.f a, b.f b, round(corr(a.v, b.v), 6) r, count(*) n FROM s a JOIN s b ON a.u = b.u AND a.f < b.f GROUP BY 1, 2")
def correlation_matrix(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.avg("l_quantity").alias("v"))
    return windows.correlation_matrix(d, "l_suppkey", "p_brand", "v").select("a", "b", _r("r"), "n")


@query("mutual_information", "WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE c FROM lineitem GROUP BY 1, 2), n AS (SELECT sum(c) n FROM c), r AS (SELECT a, sum(c) r FROM c GROUP BY 1), s AS (SELECT b, sum(c) s FROM c GROUP BY 1), h AS (SELECT (SELECT -sum(r / n * ln(r / n)) FROM r, n) x, (SELECT -sum(s / n * ln(s / n)) FROM s, n) y, (SELECT sum(c / n * ln(c * n / (r * s))) FROM c JOIN r USING (a) JOIN s USING (b), n) m) SELECT round(m / ((x + y) / 2), 8) nmi FROM h")
def mutual_information(spark, sf):
    return stats.rand_index(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(_r("nmi", 8))
