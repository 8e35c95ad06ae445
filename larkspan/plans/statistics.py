"""Statistical tests, matrices and clustering."""

from pyspark.sql import functions as F

from larkspan.operators import consensus, ml, stats
from larkspan.plans.registry import query, table


def _r(c, n=6):
    return F.round(c, n)


def _sold(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_returnflag in ('A', 'R')")


_MOM = "SELECT p_brand, count(*) FILTER (f = 'A') n1, avg(q) FILTER (f = 'A') m1, var_samp(q) FILTER (f = 'A') v1, count(*) FILTER (f = 'R') n2, avg(q) FILTER (f = 'R') m2, var_samp(q) FILTER (f = 'R') v2 FROM (SELECT p_brand, l_quantity q, l_returnflag f FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1"


@query("welch_t", f"SELECT p_brand, round(m1 - m2, 6) lfc, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) t, round((v1 / n1 + v2 / n2) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v2 / n2) ^ 2 / (n2 - 1)), 4) df FROM ({_MOM})")
def welch_t(spark, sf):
    w = stats.welch(_sold(spark, sf), ["p_brand"], "l_quantity", F.col("l_returnflag") == "A", False)
    return w.select("p_brand", _r("lfc").alias("lfc"), _r("t").alias("t"), _r("df", 4).alias("df"))


@query("welch_p")
def welch_p(spark, sf):
    from larkspan.operators.windows import fdr_bh

    w = stats.welch(_sold(spark, sf), ["p_brand"], "l_quantity", F.col("l_returnflag") == "A")
    return fdr_bh(w, [], "pval").select("p_brand", _r("pval").alias("pval"), _r("fdr").alias("fdr"))


@query("pooled_t", f"SELECT p_brand, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) t, CAST(n1 + n2 - 2 AS DOUBLE) df FROM ({_MOM})")
def pooled_t(spark, sf):
    return stats.pooled_t(_sold(spark, sf), ["p_brand"], "l_quantity", F.col("l_returnflag") == "A").select("p_brand", _r("t").alias("t"), "df")


@query("chosen_t")
def chosen_t(spark, sf):
    return stats.chosen_t(_sold(spark, sf), ["p_brand"], "l_quantity", F.col("l_returnflag") == "A").select("p_brand", "equal_var", _r("pval").alias("pval"))


@query("moderated_t", f"WITH m AS (SELECT *, sqrt(v1 / n1 + v2 / n2) se FROM ({_MOM})), s AS (SELECT quantile_cont(se, 0.1) s0 FROM m) SELECT p_brand, round((m1 - m2) / (se + s0), 6) t FROM m, s")
def moderated_t(spark, sf):
    return stats.moderated_t(_sold(spark, sf), ["p_brand"], "l_quantity", F.col("l_returnflag") == "A").select("p_brand", _r("t").alias("t"))


@query("paired_t", "SELECT l_returnflag, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 5) t, CAST(count(*) - 1 AS DOUBLE) df FROM (SELECT l_returnflag, l_discount - l_tax d FROM lineitem) GROUP BY 1")
def paired_t(spark, sf):
    return stats.paired_t(table(spark, sf, "lineitem").withColumn("d", F.col("l_discount") - F.col("l_tax")), ["l_returnflag"], "d").select("l_returnflag", _r("t", 5).alias("t"), "df")


@query("anova_f", "WITH g AS (SELECT c_nationkey % 3 k, c_mktsegment g, count(*) n, avg(c_acctbal) m, var_pop(c_acctbal) v FROM customer GROUP BY 1, 2) SELECT k, round((sum(n * m * m) - sum(n * m) ^ 2 / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) f FROM g GROUP BY 1")
def anova_f(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3)
    return stats.anova(c, ["k"], "c_mktsegment", "c_acctbal").select("k", _r("f").alias("f"))


@query("levene")
def levene(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3)
    return stats.levene(c, ["k"], "c_mktsegment", "c_acctbal").select("k", _r("f").alias("f"), _r("pval").alias("pval"))


@query("mann_whitney", "WITH r AS (SELECT c_nationkey % 3 k, c_mktsegment = 'BUILDING' a, rank() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey % 3, c_acctbal) - 1) / 2 r FROM customer) SELECT k, sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 u, round((sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2) / (count(*) FILTER (a) * count(*) FILTER (NOT a)), 6) auc FROM r GROUP BY 1")
def mann_whitney(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3)
    return stats.mann_whitney(c, ["k"], "c_acctbal", F.col("c_mktsegment") == "BUILDING").select("k", "u", _r("auc").alias("auc"))


@query("kruskal_h", "WITH r AS (SELECT c_nationkey % 3 k, c_mktsegment g, rank() OVER (PARTITION BY c_nationkey % 3 ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey % 3, c_nationkey) - 1) / 2 r FROM customer), g AS (SELECT k, g, count(*) n, sum(r) s FROM r GROUP BY 1, 2), t AS (SELECT c_nationkey % 3 k, sum(c * c * c - c) t FROM (SELECT c_nationkey, count(*)::DOUBLE c FROM customer GROUP BY 1) GROUP BY 1) SELECT k, round((12 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(t) / (sum(n) ^ 3 - sum(n))), 5) h FROM g JOIN t USING (k) GROUP BY 1")
def kruskal_h(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3)
    return stats.kruskal(c, ["k"], "c_mktsegment", "c_nationkey").select("k", _r("h", 5).alias("h"))


@query("dunn")
def dunn(spark, sf):
    return stats.dunn(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey").select("a", "b", _r("z", 5).alias("z"), _r("pval", 5).alias("pval"))


@query("chi2_cramers_v", "WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*)::DOUBLE c FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(c) OVER (PARTITION BY a) * sum(c) OVER (PARTITION BY b) / sum(c) OVER () e, sum(c) OVER () n FROM c) SELECT round(sum((c - e) ^ 2 / e), 6) chi2, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) df, round(sqrt(sum((c - e) ^ 2 / e) / (any_value(n) * (least(count(DISTINCT a), count(DISTINCT b)) - 1))), 6) cramers_v FROM e")
def chi2_cramers_v(spark, sf):
    return stats.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(_r("chi2").alias("chi2"), "df", _r("cramers_v").alias("cramers_v"))


@query("chi2_yates", "SELECT p_brand, round((a + b + c + d) * greatest(abs(a * d - b * c) - (a + b + c + d) / 2, 0) ^ 2 / ((a + b) * (c + d) * (a + c) * (b + d)), 6) chi2 FROM (SELECT p_brand, a + x a, b + x b, c + x c, d + x d FROM (SELECT *, CASE WHEN a BETWEEN 1 AND 5 OR b BETWEEN 1 AND 5 OR c BETWEEN 1 AND 5 OR d BETWEEN 1 AND 5 THEN 5 ELSE 0 END x FROM (SELECT p_brand, count(*) FILTER (p_size <= 10 AND s) ::DOUBLE a, count(*) FILTER (p_size <= 10 AND NOT s)::DOUBLE b, count(*) FILTER (p_size > 10 AND s)::DOUBLE c, count(*) FILTER (p_size > 10 AND NOT s)::DOUBLE d FROM (SELECT *, p_partkey % 3 = 0 s FROM part) GROUP BY 1)))")
def chi2_yates(spark, sf):
    small, dear = F.col("p_size") <= 10, F.col("p_partkey") % 3 == 0
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(small & dear).alias("a"), F.count_if(small & ~dear).alias("b"), F.count_if(~small & dear).alias("c"), F.count_if(~small & ~dear).alias("d"))
    return c.select("p_brand", _r(stats.chi2_2x2(*[F.col(x) for x in "abcd"])).alias("chi2"))


@query("confounding", "WITH c AS (SELECT o_orderstatus a, o_orderpriority b, count(*) + 0.5::DOUBLE c FROM orders GROUP BY 1, 2), e AS (SELECT *, sum(c) OVER (PARTITION BY a) * sum(c) OVER (PARTITION BY b) / sum(c) OVER () e FROM c) SELECT round(sum((c - e) ^ 2 / e), 6) chi2, CASE WHEN min(c) - 0.5 < 5 THEN 'partial' ELSE 'ok' END verdict FROM e")
def confounding(spark, sf):
    return stats.confounding(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(_r("chi2").alias("chi2"), "verdict")


@query("fisher_meta", "WITH s AS (SELECT n_regionkey, c_nationkey, corr(c_acctbal, c_custkey) r, count(*) n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), z AS (SELECT n_regionkey, n - 3 w, atanh(r) z FROM s WHERE n > 3) SELECT n_regionkey, count(*) k, round(tanh(sum(w * z) / sum(w)), 6) r_meta, round(sum(w * z * z) - sum(w * z) ^ 2 / sum(w), 6) q FROM z GROUP BY 1")
def fisher_meta(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_nationkey").agg(F.corr("c_acctbal", F.col("c_custkey").cast("double")).alias("r"), F.count("*").alias("n"))
    return stats.fisher_meta(d, ["n_regionkey"], "r", "n").select("n_regionkey", "k", _r("r_meta").alias("r_meta"), _r("q").alias("q"))


@query("mean_interval")
def mean_interval(spark, sf):
    return stats.mean_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", _r("low", 4).alias("low"), _r("high", 4).alias("high"))


@query("bimodality", "WITH m AS (SELECT c_mktsegment g, count(*) n, avg(c_acctbal) m, stddev_pop(c_acctbal) s FROM customer GROUP BY 1), z AS (SELECT g, any_value(n) n, avg(((c_acctbal - m) / s) ^ 3) sk, avg(((c_acctbal - m) / s) ^ 4) - 3 ku FROM customer JOIN m ON g = c_mktsegment GROUP BY 1) SELECT g c_mktsegment, round((sk * sk + 1) / (ku + 3 * (n - 1.0) ^ 2 / ((n - 2.0) * (n - 3.0))), 6) bc FROM z")
def bimodality(spark, sf):
    return stats.bimodality(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", _r("bc").alias("bc"))


@query("ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) slope, round(regr_intercept(l_extendedprice, l_quantity), 3) intercept, round(regr_r2(l_extendedprice, l_quantity), 6) r2 FROM lineitem GROUP BY 1")
def ols(spark, sf):
    return stats.simple_regression(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", _r("slope", 4).alias("slope"), _r("intercept", 3).alias("intercept"), _r("r2").alias("r2"))


@query("residuals", "WITH s AS (SELECT c_mktsegment g, regr_slope(c_acctbal, c_nationkey) b, avg(c_nationkey) x FROM customer GROUP BY 1) SELECT c_custkey, round(c_acctbal - b * (c_nationkey - x), 4) residual FROM customer JOIN s ON g = c_mktsegment")
def residuals(spark, sf):
    return stats.residuals(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey").select("c_custkey", _r("residual", 4).alias("residual"))


@query("factorial_ols")
def factorial_ols(spark, sf):
    d = _sold(spark, sf).withColumn("a", (F.col("p_size") > 25).cast("int")).withColumn("b", (F.col("l_returnflag") == "A").cast("int"))
    return stats.factorial_ols(d, ["p_brand"], "l_quantity", "a", "b").select("p_brand", "term", _r("estimate").alias("estimate"), _r("pval").alias("pval"))


@query("jaccard_pairs", "WITH s AS (SELECT DISTINCT s_nationkey u, l_partkey k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT u, count(*) n FROM s GROUP BY 1), p AS (SELECT a.u a, b.u b, count(*) shared FROM s a JOIN s b ON a.k = b.k AND a.u < b.u GROUP BY 1, 2) SELECT a, b, shared, round(shared / (x.n + y.n - shared), 6) similarity FROM p JOIN n x ON a = x.u JOIN n y ON b = y.u")
def jaccard_pairs(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return stats.jaccard_pairs(d, "s_nationkey", "l_partkey").select("a", "b", "shared", _r("similarity").alias("similarity"))


@query("rand_index", "WITH c AS (SELECT l_returnflag a, l_linestatus b, count(*)::DOUBLE c FROM lineitem GROUP BY 1, 2), s AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM c) t, (SELECT sum(r * (r - 1) / 2) FROM (SELECT sum(c) r FROM c GROUP BY a)) x, (SELECT sum(r * (r - 1) / 2) FROM (SELECT sum(c) r FROM c GROUP BY b)) y, (SELECT sum(c) FROM c) n) SELECT round((t - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)), 8) ari FROM s")
def rand_index(spark, sf):
    return stats.rand_index(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").select(_r("ari", 8).alias("ari"))


@query("embed_cosine", "WITH c AS (SELECT label, list(m ORDER BY i) c FROM (SELECT label, i, avg(embedding[i]::DOUBLE) m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 5) cos FROM embeddings JOIN c USING (label)")
def embed_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    c = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = c.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    return e.join(c, "label").select("vec_id", _r(stats.cosine(F.col("embedding"), F.col("c")), 5).alias("cos"))


@query("size_factors", "WITH d AS (SELECT l_suppkey % 10 sample, l_partkey % 40 gene, sum(l_quantity) c FROM lineitem GROUP BY 1, 2), g AS (SELECT gene, avg(ln(c)) g FROM d WHERE c > 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT sample) FROM d)) SELECT sample, round(exp(median(ln(c) - g)), 6) size_factor FROM d JOIN g USING (gene) GROUP BY 1")
def size_factors(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("sample"), (F.col("l_partkey") % 40).alias("gene")).agg(F.sum("l_quantity").alias("count"))
    return stats.size_factors(d, "sample", "gene", "count").select("sample", _r("size_factor").alias("size_factor"))


@query("expression_test")
def expression_test(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("sample"), (F.col("l_partkey") % 40).alias("gene")).agg(F.sum("l_quantity").alias("count"))
    return stats.expression_test(d, "sample", "gene", "count", F.col("sample") < 5).select("gene", _r("lfc").alias("lfc"), _r("pval").alias("pval"), "method")


@query("permutation_coupling")
def permutation_coupling(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("unit"), (F.col("l_partkey") % 6).alias("f")).agg(F.avg("l_quantity").alias("v"))
    pairs = spark.range(3).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    return stats.permutation_coupling(d, pairs, "unit", "f", "v", 99).select("a", "b", _r("rho").alias("rho"), _r("pval").alias("pval"))


@query("permanova")
def permanova(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("unit"), (F.col("l_partkey") % 6).alias("f")).agg(F.avg("l_quantity").alias("v"))
    g = d.select("unit", (F.col("unit") % 2).alias("g")).distinct()
    return stats.permanova(d, "unit", "f", "v", g, 49).select(_r("pseudo_f").alias("pseudo_f"), _r("r2").alias("r2"), _r("pval").alias("pval"))


@query("bootstrap_spearman")
def bootstrap_spearman(spark, sf):
    s = table(spark, sf, "supplier").withColumn("k", F.lit(1))
    return stats.bootstrap_spearman(s, ["k"], "s_suppkey", "s_acctbal", "s_nationkey", 50).select(_r("low").alias("low"), _r("mid").alias("mid"), _r("high").alias("high"))


@query("batch_corrected")
def batch_corrected(spark, sf):
    d = table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 20).alias("gene"), (F.col("l_suppkey") % 20).alias("sample")).agg(F.avg("l_quantity").alias("v")).withColumn("batch", F.col("sample") % 2)
    return stats.batch_corrected(d, "gene", "sample", "batch", "v").withColumn("corrected", _r("corrected"))


@query("clr", "WITH s AS (SELECT user_id, event_type, count(*)::DOUBLE v FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(ln(v) - avg(ln(v)) OVER (PARTITION BY user_id), 6) clr FROM s")
def clr(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("v"))
    return stats.clr(s, "user_id", "v").select("user_id", "event_type", _r("clr").alias("clr"))


@query("js_divergence", "WITH s AS (SELECT c_mktsegment g, c_nationkey k, count(*)::DOUBLE p, sum(abs(c_acctbal)) q FROM customer GROUP BY 1, 2), n AS (SELECT g, p / sum(p) OVER (PARTITION BY g) p, q / sum(q) OVER (PARTITION BY g) q FROM s) SELECT g c_mktsegment, round((sum(p * log2(p / ((p + q) / 2))) + sum(q * log2(q / ((p + q) / 2)))) / 2, 6) js FROM n GROUP BY 1")
def js_divergence(spark, sf):
    s = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").cast("double").alias("p"), F.sum(F.abs("c_acctbal")).alias("q"))
    return ml.jensen_shannon(s, ["c_mktsegment"], "p", "q").withColumn("js", _r("js"))


@query("marker_genes", "WITH s AS (SELECT p_type st, p_brand g, log2(count(*) + 1.0) l FROM part GROUP BY 1, 2), r AS (SELECT st, g, l - lead(l, 1, 0) OVER (PARTITION BY g ORDER BY l DESC, st DESC) gap, row_number() OVER (PARTITION BY g ORDER BY l DESC, st DESC) k FROM s) SELECT st, g, round(gap, 6) gap FROM r WHERE k = 1 AND gap > 0.1")
def marker_genes(spark, sf):
    s = table(spark, sf, "part").groupBy(F.col("p_type").alias("st"), F.col("p_brand").alias("g")).agg(F.count("*").alias("c"))
    return ml.marker_genes(s, "st", "g", "c", 0.1).select("st", "g", _r("gap").alias("gap"))


@query("signature_calls", "WITH s AS (SELECT l_suppkey, avg(l_discount) FILTER (p_type < 'M') u, avg(l_discount) FILTER (p_type > 'P') d FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT l_suppkey, round(u - d, 6) delta, CASE WHEN u - d > 0 THEN 'basal-like' ELSE 'classical' END AS call FROM s")
def signature_calls(spark, sf):
    types = sorted(r[0] for r in table(spark, sf, "part").select("p_type").distinct().collect())  # the gene list of a signature: six names
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c = ml.signature_calls(d, "l_suppkey", "p_type", "l_discount", [t for t in types if t < "M"], [t for t in types if t > "P"])
    return c.select("l_suppkey", _r("delta").alias("delta"), "call")


@query("state_grid", "SELECT a, b, count(x) n, count(x) >= 200 usable FROM (SELECT DISTINCT c_nationkey % 2 a FROM customer), (SELECT DISTINCT c_acctbal > 0 b FROM customer) LEFT JOIN (SELECT c_nationkey % 2 p, c_acctbal > 0 q, 1 x FROM customer) ON a = p AND b = q GROUP BY 1, 2")
def state_grid(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_nationkey") % 2).alias("a"), (F.col("c_acctbal") > 0).alias("b"))
    return ml.feasible_states(c, ["a", "b"], 200)


@query("pca_kmeans")
def pca_kmeans(spark, sf):
    return ml.clustered(ml.principal_components(table(spark, sf, "embeddings"), "embedding", 8), "pcs", 4).select("vec_id", "cluster")


@query("gaussian_mixture")
def gaussian_mixture(spark, sf):
    return ml.clustered(ml.principal_components(table(spark, sf, "embeddings"), "embedding", 4), "pcs", 3, "mixture").select("vec_id", "cluster")


@query("consensus_pac")
def consensus_pac(spark, sf):
    return consensus.consensus(table(spark, sf, "embeddings"), "vec_id", "embedding", [3], 20).select("pac")


@query("em_fractions")
def em_fractions(spark, sf):
    ref = {f"s{k}": {str(g): 1.0 + (g * (k + 3)) % 7 for g in range(40)} for k in range(4)}
    d = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("sample"), (F.col("l_partkey") % 40).cast("string").alias("gene")).agg(F.sum("l_quantity").alias("count"))
    return ml.em_fractions(d, ref, "sample", "gene", "count").withColumn("theta", _r("theta"))


@query("fisher_exact", """WITH t AS (SELECT p_brand, count(*) FILTER (x AND y) a, count(*) FILTER (x AND NOT y) b, count(*) FILTER (NOT x AND y) c, count(*) FILTER (NOT x AND NOT y) d
  FROM (SELECT p_brand, l_returnflag = 'A' x, l_quantity > 25 y FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1),
e AS (SELECT *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) i FROM t),
q AS (SELECT *, -(lgamma(i + 1) + lgamma(a + b - i + 1) + lgamma(a + c - i + 1) + lgamma(d - a + i + 1)) l FROM e),
p AS (SELECT *, exp(l - max(l) OVER (PARTITION BY p_brand)) p FROM q),
o AS (SELECT *, max(CASE WHEN i = a THEN p END) OVER (PARTITION BY p_brand) own FROM p)
SELECT p_brand, a, b, c, d, round(any_value(a) * any_value(d) / (any_value(b) * any_value(c))::DOUBLE, 6) odds_ratio, round(least(1, sum(p) FILTER (p <= own * (1 + 1e-7)) / sum(p)), 6) pval FROM o GROUP BY 1, 2, 3, 4, 5""")
def fisher_exact(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return stats.fisher_exact(lines, ["p_brand"], F.col("l_returnflag") == "A", F.col("l_quantity") > 25).withColumns({"odds_ratio": _r("odds_ratio"), "pval": _r("pval")})


@query("shapiro")
def shapiro(spark, sf):
    return stats.shapiro(table(spark, sf, "part"), ["p_brand"], "p_retailprice").select("p_brand", "n", _r("w", 5).alias("w"), _r("pval", 5).alias("pval"))


@query("dunnett")
def dunnett(spark, sf):
    c = table(spark, sf, "customer").withColumn("k", F.col("c_nationkey") % 3)
    return stats.dunnett(c, ["k"], "c_mktsegment", "c_acctbal", "BUILDING").select("k", "c_mktsegment", _r("difference", 4).alias("difference"), _r("t", 5).alias("t"), "df", _r("pval", 5).alias("pval"))


@query("dunnett_t", """WITH g AS (SELECT c_nationkey % 3 k, c_mktsegment s, count(*) n, avg(c_acctbal) m, var_pop(c_acctbal) v FROM customer GROUP BY 1, 2), p AS (SELECT k, sum(n * v) / (sum(n) - count(*)) s2, sum(n) - count(*) df FROM g GROUP BY 1)
SELECT g.k, g.s c_mktsegment, round(g.m - b.m, 4) difference, round((g.m - b.m) / sqrt(s2 * (1.0 / g.n + 1.0 / b.n)), 5) t, CAST(df AS DOUBLE) df FROM g JOIN g b ON b.k = g.k AND b.s = 'BUILDING' AND g.s <> 'BUILDING' JOIN p ON p.k = g.k""")
def dunnett_t(spark, sf):
    return dunnett(spark, sf).drop("pval")


@query("levene_f", """WITH m AS (SELECT c_nationkey % 3 k, c_mktsegment g, median(c_acctbal) md FROM customer GROUP BY 1, 2), d AS (SELECT k, g, abs(c_acctbal - md) x FROM customer JOIN m ON k = c_nationkey % 3 AND g = c_mktsegment),
s AS (SELECT k, g, count(*) n, avg(x) m, var_pop(x) v FROM d GROUP BY 1, 2) SELECT k, round((sum(n * m * m) - sum(n * m) ^ 2 / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) f FROM s GROUP BY 1""")
def levene_f(spark, sf):
    return levene(spark, sf).select("k", "f")


@query("dunn_z", """WITH r AS (SELECT c_mktsegment g, c_nationkey v, rank() OVER (ORDER BY c_nationkey) + (count(*) OVER (PARTITION BY c_nationkey) - 1) / 2 r FROM customer), s AS (SELECT g, count(*) n, avg(r) m FROM r GROUP BY 1),
t AS (SELECT sum(c * c * c - c) t, sum(c) n FROM (SELECT count(*)::DOUBLE c FROM customer GROUP BY c_nationkey))
SELECT x.g a, y.g b, round((x.m - y.m) / sqrt((t.n * (t.n + 1) / 12 - t / (12 * (t.n - 1))) * (1.0 / x.n + 1.0 / y.n)), 5) z FROM s x JOIN s y ON x.g < y.g, t""")
def dunn_z(spark, sf):
    return dunn(spark, sf).select("a", "b", "z")


@query("interval_centres", "SELECT c_mktsegment, round(avg(c_acctbal), 3) centre FROM customer GROUP BY 1")
def interval_centres(spark, sf):
    return stats.mean_interval(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_mktsegment", F.round((F.col("low") + F.col("high")) / 2, 3).alias("centre"))


@query("factorial_estimates", """WITH c AS (SELECT p_brand, avg(q) FILTER (a = 0 AND b = 0) m00, avg(q) FILTER (a = 1 AND b = 0) m10, avg(q) FILTER (a = 0 AND b = 1) m01, avg(q) FILTER (a = 1 AND b = 1) m11
  FROM (SELECT p_brand, l_quantity q, CAST(p_size > 25 AS INT) a, CAST(l_returnflag = 'A' AS INT) b FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R')) GROUP BY 1)
SELECT p_brand, unnest(['a', 'b', 'ab']) term, round(unnest([m10 - m00, m01 - m00, m11 - m10 - m01 + m00]), 6) estimate FROM c WHERE m00 IS NOT NULL AND m01 IS NOT NULL AND m10 IS NOT NULL AND m11 IS NOT NULL""")
def factorial_estimates(spark, sf):
    return factorial_ols(spark, sf).select("p_brand", "term", "estimate")


@query("permanova_f", """WITH d AS (SELECT l_suppkey % 20 u, l_partkey % 6 f, avg(l_quantity) v FROM lineitem GROUP BY 1, 2), g AS (SELECT u, u % 2 g FROM d GROUP BY 1), m AS (SELECT g, count(*) m FROM g GROUP BY 1),
p AS (SELECT x.u a, y.u b, sum((x.v - y.v) ^ 2) d2 FROM d x JOIN d y ON x.f = y.f AND x.u < y.u GROUP BY 1, 2),
w AS (SELECT sum(d2 / m) ssw FROM p JOIN g x ON x.u = a JOIN g y ON y.u = b AND x.g = y.g JOIN m ON m.g = x.g), t AS (SELECT sum(d2) / (SELECT count(*) FROM g) sst FROM p)
SELECT round((sst - ssw) / ((SELECT count(*) FROM m) - 1) / (ssw / ((SELECT count(*) FROM g) - (SELECT count(*) FROM m))), 6) pseudo_f, round(1 - ssw / sst, 6) r2 FROM w, t""")
def permanova_f(spark, sf):
    return permanova(spark, sf).select("pseudo_f", "r2")
