"""Ordered analytics, scalar functions and pathway mathematics."""

from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.operators import aggregates as A
from larkspan.operators import pathways, windows
from larkspan.plans.registry import query, table


def _r(c, n=6):
    return F.round(c, n)


@query("entropy_by_group", "WITH c AS (SELECT user_id, event_type, count(*) w FROM events GROUP BY 1, 2), p AS (SELECT user_id, w / sum(w) OVER (PARTITION BY user_id) p FROM c) SELECT user_id, count(*) n_items, round(-sum(p * log2(p)), 6) entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) norm_entropy FROM p GROUP BY 1 HAVING count(*) > 1")
def entropy_by_group(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("w"))
    return A.entropy(e, ["user_id"], "w").where("n_items > 1").select("user_id", "n_items", _r("entropy").alias("entropy"), _r("norm_entropy").alias("norm_entropy"))


@query("score_k", "WITH c AS (SELECT CAST(ts AS DATE) d, user_id, event_type, count(*) w FROM events GROUP BY 1, 2, 3), p AS (SELECT d, user_id, w, w / sum(w) OVER (PARTITION BY d, user_id) p FROM c), h AS (SELECT d, user_id, sum(w) s, count(*) k, -sum(p * log2(p)) h FROM p GROUP BY 1, 2), g AS (SELECT d, s, CASE WHEN k > 1 THEN h / log2(k) ELSE 0 END v FROM h) SELECT CAST(d AS VARCHAR) d, round(sum(s * v) / sum(s), 6) weighted, round(avg(v), 6) mean, round(stddev_samp(v), 6) std, CAST(min(s) AS BIGINT) min_size, CAST(max(s) AS BIGINT) max_size, count(*) FILTER (s < 3) n_small FROM g GROUP BY 1")
def score_k(spark, sf):
    c = table(spark, sf, "events").groupBy(F.to_date("ts").cast("string").alias("d"), "user_id", "event_type").agg(F.count("*").alias("w"))
    size = c.groupBy("d", "user_id").agg(F.sum("w").alias("s"))
    s = A.score_partition(A.entropy(c, ["d", "user_id"], "w").join(size, ["d", "user_id"]), "d", "s", "norm_entropy")
    return s.select("d", _r("weighted").alias("weighted"), _r("mean").alias("mean"), _r("std").alias("std"), "min_size", "max_size", "n_small")


@query("qcut_bins", "WITH e AS (SELECT quantile_cont(c_acctbal, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) q FROM customer) SELECT c_custkey, greatest(len(list_filter(q[2:], lambda x: x < c_acctbal)), 0)::INT bin FROM customer, e")
def qcut_bins(spark, sf):
    return A.quantile_bins(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 10).select("c_custkey", "bin")


@query("msa_entropy", "WITH c AS (SELECT i - 1 pos, substr(p_brand, i, 1) ch, count(*) c FROM part, LATERAL (SELECT unnest(range(1, length(p_brand) + 1)) i) GROUP BY 1, 2), p AS (SELECT pos, ch, c, c / sum(c) OVER (PARTITION BY pos) p FROM c), h AS (SELECT pos, sum(c) n, -sum(p * log2(p)) h, sum((1 + log2(p)) * (1 + log2(p)) * p * (1 - p)) v, max_by(ch, c * 1000 + ascii(ch)) best FROM p GROUP BY 1) SELECT CAST(pos AS INT) pos, CAST(n AS BIGINT) n, round(h, 6) + 0 entropy, round(h * sqrt(v / n), 6) + 0 se, best FROM h")
def msa_entropy(spark, sf):
    h = A.column_entropy(table(spark, sf, "part"), "p_brand")
    return h.select("pos", "n", (_r("entropy") + F.lit(0.0)).alias("entropy"), (_r("se") + F.lit(0.0)).alias("se"), "best")


@query("fdr_bh", "WITH c AS (SELECT o_orderstatus, o_orderkey, o_totalprice / max(o_totalprice) OVER () p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY p) k, count(*) OVER (PARTITION BY o_orderstatus) n FROM c) SELECT o_orderstatus, o_orderkey, round(least(1, min(p * n / k) OVER (PARTITION BY o_orderstatus ORDER BY k DESC ROWS UNBOUNDED PRECEDING)), 6) fdr FROM r")
def fdr_bh(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    top = o.agg(F.max("o_totalprice").alias("m"))
    p = o.crossJoin(F.broadcast(top)).withColumn("p", F.col("o_totalprice") / F.col("m"))
    return windows.fdr_bh(p, ["o_orderstatus"], "p").select("o_orderstatus", "o_orderkey", _r("fdr").alias("fdr"))


@query("fdr_naive", "WITH r AS (SELECT l_returnflag, l_discount / 0.1 p, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2 k, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem) SELECT l_returnflag, round(p, 6) p, round(least(1, p * n / k), 6) fdr, count(*) n FROM r GROUP BY 1, 2, 3")
def fdr_naive(spark, sf):
    p = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") / 0.1).alias("p"))
    return windows.fdr_naive(p, ["l_returnflag"], "p").groupBy("l_returnflag", _r("p").alias("p"), _r("fdr").alias("fdr")).agg(F.count("*").alias("n"))


_STAT = "s AS (SELECT l_suppkey, p_type g, avg(l_discount) - 0.05 z FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), x AS (SELECT l_suppkey, g, z, row_number() OVER (PARTITION BY l_suppkey ORDER BY z DESC, g) r, count(*) OVER (PARTITION BY l_suppkey) n FROM s)"


def _es_sql(name, cond):
    return f"{name} AS (SELECT l_suppkey, CASE WHEN max(h) = 0 OR max(h) = max(n) THEN 0.0 ELSE max_by(d, round(abs(d), 9) * 1e6 - r / 1e3) END es, CAST(max(h) AS BIGINT) nh FROM (SELECT l_suppkey, r, n, sum(CASE WHEN {cond} THEN 1 ELSE 0 END) OVER w0 h, sum(CASE WHEN {cond} THEN abs(z) ELSE 0 END) OVER w / greatest(sum(CASE WHEN {cond} THEN abs(z) ELSE 0 END) OVER w0, 1e-12) - sum(CASE WHEN {cond} THEN 0.0 ELSE 1.0 END) OVER w / nullif(sum(CASE WHEN {cond} THEN 0.0 ELSE 1.0 END) OVER w0, 0) d FROM x WINDOW w AS (PARTITION BY l_suppkey ORDER BY r ROWS UNBOUNDED PRECEDING), w0 AS (PARTITION BY l_suppkey)) GROUP BY 1)"


def _stat(spark, sf):
    d = A.placed(table(spark, sf, "lineitem")).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_type", "g")
    return A.mean_in_order(d, ["l_suppkey", "g"], "l_discount", "place", "m").select("l_suppkey", "g", (F.col("m") - 0.05).alias("z"))


@query("enrichment_score", f"WITH {_STAT}, {_es_sql('e', 'g < ' + chr(39) + 'M' + chr(39))} SELECT l_suppkey, round(es, 6) es, nh n_hits FROM e")
def enrichment_score(spark, sf):
    return windows.enrichment_score(_stat(spark, sf).withColumn("hit", F.col("g") < "M"), ["l_suppkey"], "z", "hit", "g").select("l_suppkey", _r("es").alias("es"), "n_hits")


@query("wtcs_ncs", f"WITH {_STAT}, {_es_sql('u', 'g < ' + chr(39) + 'L' + chr(39))}, {_es_sql('v', 'g > ' + chr(39) + 'P' + chr(39))}, w AS (SELECT l_suppkey, l_suppkey % 5 grp, CASE WHEN sign(u.es) = sign(v.es) THEN 0 ELSE (u.es - v.es) / 2 END w FROM u JOIN v USING (l_suppkey)) SELECT l_suppkey, round(w, 6) wtcs, round(CASE WHEN w > 0 THEN w / avg(CASE WHEN w > 0 THEN w END) OVER (PARTITION BY grp) WHEN w < 0 THEN w / avg(CASE WHEN w < 0 THEN -w END) OVER (PARTITION BY grp) ELSE 0 END, 6) ncs FROM w")
def wtcs_ncs(spark, sf):
    s = _stat(spark, sf)
    up = windows.enrichment_score(s.withColumn("hit", F.col("g") < "L"), ["l_suppkey"], "z", "hit", "g", "es_up").drop("n_hits")
    dn = windows.enrichment_score(s.withColumn("hit", F.col("g") > "P"), ["l_suppkey"], "z", "hit", "g", "es_dn").drop("n_hits")
    w = up.join(dn, "l_suppkey").withColumn("wtcs", windows.connectivity("es_up", "es_dn"))
    n = windows.normalised_connectivity(w.withColumn("grp", F.col("l_suppkey") % 5), ["grp"], "wtcs")
    return n.select("l_suppkey", _r("wtcs").alias("wtcs"), _r("ncs").alias("ncs"))


@query("connectivity_ends", "WITH s AS (SELECT l_suppkey, l_returnflag f, avg(l_discount) v FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v, l_suppkey) a, row_number() OVER (PARTITION BY f ORDER BY v DESC, l_suppkey) d FROM s) SELECT f, l_suppkey, CAST(a AS INT) AS rank, 'bottom' side FROM r WHERE a <= 4 UNION ALL SELECT f, l_suppkey, CAST(d AS INT), 'top' FROM r WHERE d <= 4")
def connectivity_ends(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("f")).agg(F.avg("l_discount").alias("v"))
    return windows.ends(s, ["f"], "v", "l_suppkey", 4).select("f", "l_suppkey", "rank", "side")


@query("zscore_batch", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_samp(c_acctbal) OVER w, 6) z, round((c_acctbal - avg(c_acctbal) OVER w) / stddev_pop(c_acctbal) OVER w, 6) z0 FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def zscore_batch(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    z = windows.zscore(windows.zscore(c, ["c_mktsegment"], "c_acctbal"), ["c_mktsegment"], "c_acctbal", False, "z0")
    return z.select("c_custkey", _r("z").alias("z"), _r("z0").alias("z0"))


@query("spearman", "WITH c AS (SELECT c_mktsegment, c_acctbal a, CAST(c_nationkey AS DOUBLE) b FROM customer), r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY a) + (count(*) OVER (PARTITION BY c_mktsegment, a) - 1) / 2 ra, rank() OVER (PARTITION BY c_mktsegment ORDER BY b) + (count(*) OVER (PARTITION BY c_mktsegment, b) - 1) / 2 rb FROM c) SELECT c_mktsegment, round(corr(ra, rb), 6) rho FROM r GROUP BY 1")
def spearman(spark, sf):
    return windows.spearman(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey").withColumn("rho", _r("rho"))


@query("pearson_top", "WITH s AS (SELECT p_brand f, l_suppkey u, avg(l_quantity) v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), o AS (SELECT u, v y FROM s WHERE f = 'Brand#11') SELECT f p_brand, round(corr(v, y), 6) r, count(*) n FROM s JOIN o USING (u) WHERE f <> 'Brand#11' GROUP BY 1")
def pearson_top(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_suppkey").agg(F.avg("l_quantity").alias("v"))
    return windows.correlations(d, "l_suppkey", "p_brand", "v", "Brand#11").withColumn("r", _r("r"))


@query("median_step", "SELECT o_custkey, median(d) median_step FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) d FROM orders) GROUP BY 1")
def median_step(spark, sf):
    return windows.median_step(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey")


@query("median_split", "SELECT c_custkey, CASE WHEN c_acctbal > median(c_acctbal) OVER (PARTITION BY c_mktsegment) THEN 'high' ELSE 'low' END half FROM customer")
def median_split(spark, sf):
    return windows.median_split(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal").select("c_custkey", "half")


@query("curve_choice", "WITH g AS (SELECT f, l, count(*) FILTER (l_discount >= l AND l_tax < f) n FROM lineitem, (VALUES (0.02::DOUBLE), (0.05::DOUBLE)) a(f), (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.06::DOUBLE), (0.09::DOUBLE)) b(l) GROUP BY 1, 2) SELECT f fdr_cut, round(corr(l, n), 6) r, f = 0.02 chosen FROM g GROUP BY 1")
def curve_choice(spark, sf):
    from larkspan.operators import filters

    li = table(spark, sf, "lineitem").withColumn("k", F.lit(1))
    g = filters.threshold_counts(li, ["k"], "l_discount", "l_tax", [0.01, 0.03, 0.06, 0.09], [0.02, 0.05])
    return windows.curve_choice(g, "fdr_cut", "lfc_cut", "n").select("fdr_cut", _r("r").alias("r"), "chosen")


_PPMI = """WITH l AS (SELECT p_partkey, p_brand, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () * 2 v FROM part),
s AS (SELECT p_brand, coalesce(sum(least(v, 3)) FILTER (v > 0), 0) up, coalesce(sum(greatest(v, -3)) FILTER (v < 0), 0) dw, count(*) FILTER (v > 0) n_up, count(*) FILTER (v < 0) n_dw FROM l WHERE abs(v) >= 0.4 GROUP BY 1),
r AS (SELECT *, abs(CASE WHEN dw = 0 THEN up * 3 WHEN up = 0 THEN 1 / (3 * dw) ELSE up / dw END) ratio, CASE WHEN n_up > 0 THEN up / n_up ELSE 0 END un, CASE WHEN n_dw > 0 THEN dw / n_dw ELSE 0 END dn FROM s)
SELECT p_brand, round(up, 5) + 0 up, round(dw, 5) + 0 dw, n_up, n_dw, round(log2(ratio), 5) + 0 ppmi_total, round(log2(abs(CASE WHEN dn = 0 THEN un / 0.2 WHEN un = 0 THEN 0.2 / dn ELSE un / dn END)), 5) + 0 ppmi_norm FROM r"""


@query("pathway_index", _PPMI)
def pathway_index(spark, sf):
    p = table(spark, sf, "part")
    m = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"))
    lfc = p.crossJoin(F.broadcast(m)).select("p_partkey", ((F.col("p_retailprice") - F.col("m")) / F.col("s") * 2).alias("v"))
    i = pathways.modulation_index(p.select("p_brand", "p_partkey"), lfc, "p_brand", "p_partkey", "v")
    return i.select("p_brand", *[_r(c, 5).alias(c) for c in ("up", "dw")], "n_up", "n_dw", *[_r(c, 5).alias(c) for c in ("ppmi_total", "ppmi_norm")])


@query("toi_scores", "WITH t AS (SELECT p_brand, p_type, count(*) FILTER (p_size > 25) d, count(*) n, 0.001 + avg(p_size) / 1000 f FROM part GROUP BY 1, 2), s AS (SELECT p_brand, sqrt(-log10(f) * d / n) t1, sqrt(log10(0.05) * log10(f)) t2, -log10(f) * -log10(0.05) * d / n / 3 t3, -log10(f) * -log10(0.05) * d / n * d / 4 t4 FROM t) SELECT p_brand, count(*) n_pathways, round(avg(t1), 6) toi1_mean, round(median(t2), 6) toi2_median, round(stddev_pop(t3), 6) toi3_std, round(avg(t4), 6) toi4_mean FROM s GROUP BY 1")
def toi_scores(spark, sf):
    t = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count_if(F.col("p_size") > 25).alias("d"), F.count("*").alias("n"), (0.001 + F.avg("p_size") / 1000).alias("f")).withColumn("lf", F.lit(0.05))
    s = pathways.toi_summary(pathways.toi_scores(t, "d", "n", "f", "lf"), ["p_brand"])
    return s.select("p_brand", "n_pathways", *[_r(c).alias(c) for c in ("toi1_mean", "toi2_median", "toi3_std", "toi4_mean")])


@query("hypergeom_sf", "WITH u AS (SELECT count(*) pop, count(*) FILTER (p_size <= 10) dr FROM part), s AS (SELECT p_brand, count(*) marked, count(*) FILTER (p_size <= 10) k FROM part GROUP BY 1), x AS (SELECT *, unnest(range(k, least(marked, dr) + 1)) i FROM s, u WHERE k >= 2) SELECT p_brand, marked, k, round(sum(exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(pop - marked + 1) - lgamma(dr - i + 1) - lgamma(pop - marked - dr + i + 1) - lgamma(pop + 1) + lgamma(dr + 1) + lgamma(pop - dr + 1))), 6) pval FROM x GROUP BY 1, 2, 3")
def hypergeom_sf(spark, sf):
    p = table(spark, sf, "part")
    e = pathways.enriched_sets(p.select("p_brand", "p_partkey"), p.where("p_size <= 10"), p, "p_brand", "p_partkey")
    return e.select("p_brand", "marked", "k", _r("pval").alias("pval"))


@query("gene_lists", "SELECT p_brand, array_to_string(list_sort(list_distinct(list(p_type))), ',') genes, count(DISTINCT p_type) n_genes FROM part GROUP BY 1")
def gene_lists(spark, sf):
    return pathways.gene_lists(table(spark, sf, "part"), ["p_brand"], "p_type").withColumn("genes", F.array_join("genes", ","))


@query("top_labels", "WITH r AS (SELECT c_mktsegment, c_name, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY abs(c_acctbal) DESC, c_name) k FROM customer) SELECT c_mktsegment, string_agg(c_name || ' (' || printf('%.2f', c_acctbal) || ')', ';' ORDER BY c_name) labels FROM r WHERE k <= 10 GROUP BY 1")
def top_labels(spark, sf):
    return pathways.top_labels(table(spark, sf, "customer"), ["c_mktsegment"], "c_name", "c_acctbal", 10).withColumn("labels", F.array_join("labels", ";"))


@query("best_quantile_row", "WITH e AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.9) lo, quantile_cont(c_acctbal, 0.95) hi FROM customer GROUP BY 1), r AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) k FROM customer JOIN e USING (c_mktsegment) WHERE c_acctbal > lo AND c_acctbal <= hi) SELECT c_mktsegment, c_custkey FROM r WHERE k = 1")
def best_quantile_row(spark, sf):
    return pathways.best_quantile_row(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey", 0.9).select("c_mktsegment", "c_custkey")


@query("json_extract", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) k, md5(props) h FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", S.as_int(F.get_json_object("props", "$.k")).alias("k"), F.md5(F.col("props").cast("binary")).alias("h"))


@query("text_functions", "SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' NOS, (x)'), '\\bnos\\b', '', 'g'), '[,;()]', ' ', 'g'), '\\s+', ' ', 'g')) norm, split_part(p_name, ' ', -1) last, CASE WHEN starts_with(st, 'STAGE X') THEN 'missing' WHEN starts_with(st, 'STAGE IV') THEN 'IV' WHEN starts_with(st, 'STAGE III') THEN 'III' WHEN starts_with(st, 'STAGE II') THEN 'II' WHEN starts_with(st, 'STAGE I') THEN 'I' WHEN starts_with(st, 'UNKNOWN') THEN 'missing' END stage, lpad(CAST(p_size AS VARCHAR), 5, '0') pad, regexp_replace('ENSG' || p_partkey || '.' || p_size, '\\.\\d+$', '') gene FROM (SELECT *, ['STAGE X', 'STAGE IVA', 'STAGE IIIB', 'STAGE II', 'STAGE I', 'UNKNOWN', 'NA'][p_size % 7 + 1] st FROM part)")
def text_functions(spark, sf):
    stages = F.array(*[F.lit(x) for x in ("Stage X", "stage IVA ", "Stage IIIB", "Stage II", "stage i", "unknown", "NA")])
    p = table(spark, sf, "part")
    return p.select("p_partkey", S.normalise(F.concat("p_name", F.lit(" NOS, (x)"))).alias("norm"), S.last_token("p_name").alias("last"), S.stage(F.get(stages, F.col("p_size") % 7)).alias("stage"), S.padded("p_size", 5, "0").alias("pad"), S.without_version(F.concat(F.lit("ENSG"), "p_partkey", F.lit("."), "p_size")).alias("gene"))


@query("label_functions", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v >= 3 THEN 'up_3' WHEN v >= 2 THEN 'up_2' WHEN v >= 1 THEN 'up_1' WHEN v >= 0.4 THEN '+weak' WHEN v <= -3 THEN 'down_3' WHEN v <= -2 THEN 'down_2' WHEN v <= -1 THEN 'down_1' WHEN v <= -0.4 THEN '-weak' ELSE '~zero' END bin, CASE WHEN l_tax >= 0.05 THEN 'NS' WHEN l_tax > 0.01 THEN '*' WHEN l_tax > 0.001 THEN '**' WHEN l_tax > 0.0001 THEN '***' ELSE '****' END stars, CASE WHEN v > 0.4 THEN 'up' WHEN v < -0.4 THEN 'dw' ELSE '--' END || '/' || CASE WHEN l_discount > 0.4 THEN 'up' ELSE '--' END pair FROM (SELECT *, (l_quantity - 25) / 6 v FROM lineitem)")
def label_functions(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("v", (F.col("l_quantity") - 25) / 6)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.lfc_bin("v").alias("bin"), S.stars("l_tax").alias("stars"), S.pair_label("v", "l_discount").alias("pair"))


@query("barcode_truncate", "SELECT c_custkey, 'TCGA-' || substr(c_mktsegment, 1, 2) || '-' || c_custkey || '-' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') barcode, 'TCGA-' || substr(c_mktsegment, 1, 2) subject FROM customer")
def barcode_truncate(spark, sf):
    full = F.concat_ws("-", F.lit("TCGA"), F.substring("c_mktsegment", 1, 2), "c_custkey", F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("A")))
    return table(spark, sf, "customer").select("c_custkey", S.sample_barcode(full).alias("barcode"), S.subject(full).alias("subject"))


@query("date_functions", "SELECT event_id, CASE WHEN month(ts) <= 6 THEN 1 ELSE 2 END semester, strftime(ts, '%Y-%m-%d') d, true ok FROM events")
def date_functions(spark, sf):
    d = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").select("event_id", S.semester(F.month("ts")).alias("semester"), d.alias("d"), S.is_date(d).alias("ok"))


@query("evidence_functions", "SELECT p_partkey, round(1 / (1 - r), 6) ceiling, round(CASE WHEN lr >= 1 THEN lr / (r + (1 - r) * lr) ELSE r * lr + 1 - r END, 6) lr_eff, round(-(q * log2(q) + (1 - q) * log2(1 - q)), 6) h FROM (SELECT p_partkey, p_size / 60.0::DOUBLE r, p_size / 10.0::DOUBLE lr, p_size / 100.0::DOUBLE q FROM part)")
def evidence_functions(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 60).alias("r"), (F.col("p_size") / 10).alias("lr"), (F.col("p_size") / 100).alias("q"))
    return p.select("p_partkey", _r(S.information_ceiling("r")).alias("ceiling"), _r(S.attenuated_lr("lr", "r")).alias("lr_eff"), _r(S.binary_entropy("q")).alias("h"))


@query("window_counts", "SELECT epoch(date_trunc('hour', ts))::BIGINT h, event_type, count(*) n FROM events GROUP BY 1, 2")
def window_counts(spark, sf):
    from larkspan.streaming.windows import hourly_counts

    return hourly_counts(table(spark, sf, "events")).select(F.unix_timestamp("hour").alias("h"), "event_type", "n")
