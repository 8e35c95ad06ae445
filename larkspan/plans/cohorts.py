"""Cohort queries."""

from pyspark.sql import functions as F

from larkspan.operators import cohorts as C
from larkspan.plans.registry import query, table


def _r(c, n=6):
    return F.round(c, n)


@query("shared_across", "WITH d AS (SELECT s_nationkey % 3 g, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT l_partkey FROM d GROUP BY 1 HAVING count(DISTINCT g) = (SELECT count(DISTINCT g) FROM d)) SELECT l_partkey, count(*) n FROM d WHERE l_partkey IN (SELECT * FROM k) GROUP BY 1")
def shared_across(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select((F.col("s_nationkey") % 3).alias("g"), "l_partkey")
    return C.shared_across(d, "g", "l_partkey").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("sample_metadata", "WITH s AS (SELECT n_name study, unnest([{'c': 'tumour', 'n': n_nationkey}, {'c': 'normal', 'n': n_regionkey}]) p FROM nation) SELECT study, p.c AS condition, CAST(i AS INT) number, study || '_' || p.c || '_' || i sample FROM s, LATERAL (SELECT unnest(range(1, p.n + 1)) i)")
def sample_metadata(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("study"), "n_nationkey", "n_regionkey")
    return C.sample_metadata(n, "study", {"tumour": "n_nationkey", "normal": "n_regionkey"})


@query("control_choice", "SELECT n_nationkey, CASE WHEN n_regionkey >= 3 THEN 'normal' WHEN n_nationkey >= 3 THEN 'reference' ELSE 'none' END c FROM nation")
def control_choice(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", C.controls(F.col("n_regionkey"), F.col("n_nationkey")).alias("c"))


@query("first_known", "SELECT user_id, arg_min(t, event_id) FILTER (t IS NOT NULL) t FROM (SELECT user_id, event_id, nullif(event_type, 'view') t FROM events) GROUP BY 1")
def first_known(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.nullif("event_type", F.lit("view")).alias("t"))
    return C.first_known(e, "user_id", "t", "event_id")


@query("repeated_keys", "SELECT p_name, count(*) n FROM part GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return C.repeated_keys(table(spark, sf, "part"), "p_name")


@query("sectors", "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN a > 1 THEN 'a' END, CASE WHEN b > 1 THEN 'b' END], lambda x: x IS NOT NULL), ',') ups, array_to_string(list_filter([CASE WHEN a < -1 THEN 'a' END, CASE WHEN b < -1 THEN 'b' END], lambda x: x IS NOT NULL), ',') downs, abs(a) >= 1 OR abs(b) >= 1 strong, (a >= 1 OR b >= 1) AND (a <= -1 OR b <= -1) both_signs, round(abs(a - b), 6) spread FROM (SELECT *, (l_quantity - 25) / 10 a, l_discount * 60 - 3 b FROM lineitem)")
def sectors(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("a", (F.col("l_quantity") - 25) / 10).withColumn("b", F.col("l_discount") * 60 - 3)
    s = C.sectors(["a", "b"], 1, 1)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(s["ups"], ",").alias("ups"), F.array_join(s["downs"], ",").alias("downs"), s["strong"].alias("strong"), s["both_signs"].alias("both_signs"), _r(s["spread"]).alias("spread"))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 5).alias("line"), (F.col("l_partkey") % 12).alias("gene"), F.col("l_returnflag").alias("drug"), F.col("l_quantity").alias("v"))


@query("treated_minus_vehicle", "WITH m AS (SELECT l_suppkey % 5 line, l_returnflag drug, l_partkey % 12 gene, avg(l_quantity) m FROM lineitem GROUP BY 1, 2, 3) SELECT a.line, a.drug, a.gene, round(a.m - b.m, 6) + 0 shift FROM m a JOIN m b ON a.line = b.line AND a.gene = b.gene AND b.drug = 'N' WHERE a.drug <> 'N'")
def treated_minus_vehicle(spark, sf):
    return C.treated_minus_vehicle(_lines(spark, sf), "line", "gene", "drug", "v", "N", 5).withColumn("shift", _r("shift"))


@query("selectivity", "SELECT l_partkey, round(avg(CASE WHEN l_discount - 0.08 < -0.06 THEN 1.0 ELSE 0 END), 6) share, CASE WHEN avg(CASE WHEN l_discount - 0.08 < -0.06 THEN 1.0 ELSE 0 END) >= 0.8 THEN 'common' WHEN avg(CASE WHEN l_discount - 0.08 < -0.06 THEN 1.0 ELSE 0 END) > 0 THEN 'selective' ELSE 'none' END label FROM lineitem GROUP BY 1")
def selectivity(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("v", F.col("l_discount") - 0.08)
    return C.selectivity(li, "l_partkey", "v", -0.06).select("l_partkey", _r("share").alias("share"), "label")


@query("centred_assignment", "WITH m AS (SELECT l_suppkey u, l_partkey % 12 f, avg(l_quantity) v FROM lineitem GROUP BY 1, 2), c AS (SELECT l_suppkey % 3 k, l_partkey % 12 f, avg(l_quantity) c FROM lineitem GROUP BY 1, 2), r AS (SELECT u, k, corr(v, c) r FROM m JOIN c USING (f) GROUP BY 1, 2) SELECT u, CAST(arg_max(k, r) AS BIGINT) k, round(max(r), 6) r FROM r GROUP BY 1")
def centred_assignment(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("f", F.col("l_partkey") % 12)
    m = li.groupBy(F.col("l_suppkey").alias("u"), "f").agg(F.avg("l_quantity").alias("v"))
    c = li.groupBy((F.col("l_suppkey") % 3).alias("k"), "f").agg(F.avg("l_quantity").alias("v"))
    return C.centred_assignment(m, "u", "f", "v", c, "k").withColumn("r", _r("r"))


@query("random_sets")
def random_sets(spark, sf):
    p = table(spark, sf, "part")
    sets = p.select("p_brand", "p_partkey")
    sim = C.random_set_overlaps(p, "p_partkey", sets, "p_brand", 100, 20)
    seen = p.where("p_size <= 3").groupBy("p_brand").agg(F.count("*").alias("overlap"))
    return C.empirical_p(seen, sim, "p_brand", 20).withColumn("pval", _r("pval"))


@query("bayesian_cutoff")
def bayesian_cutoff(spark, sf):
    from larkspan.operators import filters

    li = table(spark, sf, "lineitem").withColumn("k", F.lit(1))
    g = filters.threshold_counts(li, ["k"], "l_discount", "l_tax", [i / 100 for i in range(1, 10)], [0.05])
    return C.bayesian_cutoff(g, "lfc_cut", "n", li.count(), 0.04, 0.02).select(*[_r(c).alias(c) for c in ("mean", "mode", "low", "high")])


@query("stacked_quantiles", "SELECT CAST(p AS DOUBLE) point, round(CASE WHEN p = 0.25 THEN quantile_cont(v, 0.25) WHEN p = 0.5 THEN quantile_cont(v, 0.5) ELSE quantile_cont(v, 0.9) END, 6) AS value FROM (SELECT unnest([l_discount, l_tax]) v FROM lineitem), (VALUES (0.25), (0.5), (0.9)) t(p) GROUP BY p")
def stacked_quantiles(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_discount", "l_tax")
    return C.stacked_quantiles(li, "l_orderkey", [0.25, 0.5, 0.9]).withColumn("value", _r("value"))
