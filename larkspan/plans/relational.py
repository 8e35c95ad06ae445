"""Relational queries: filters, joins, aggregation, reshaping and set operations."""

from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.operators import aggregates as A
from larkspan.operators import filters, joins, sets
from larkspan.plans.registry import query, table
from larkspan.sources import tables as src


def _r(c, n=6):
    return F.round(c, n)


@query("nunique_topk", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderpriority ORDER BY 2 DESC, 1 LIMIT 5")
def nunique_topk(spark, sf):
    return A.distinct_counts(table(spark, sf, "orders"), "o_orderpriority", "o_custkey", "n_customers").orderBy(F.desc("n_customers"), "o_orderpriority").limit(5)


@query("deg_filter_sort", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_tax, CASE WHEN l_discount > 0 THEN 'up' WHEN l_discount < 0 THEN 'down' END AS direction FROM lineitem WHERE abs(l_discount) >= 0.05 AND l_tax < 0.04 ORDER BY l_tax, l_orderkey")
def deg_filter_sort(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax")
    return filters.up_down(filters.degs(li, 0.05, 0.04, "l_discount", "l_tax"), "l_discount").orderBy("l_tax", "l_orderkey")


@query("threshold_grid", "WITH g AS (SELECT * FROM (VALUES (0.02), (0.05), (0.08)) a(lfc_cut), (VALUES (0.02), (0.04), (0.06)) b(fdr_cut)) SELECT l_returnflag, CAST(lfc_cut AS DOUBLE) lfc_cut, CAST(fdr_cut AS DOUBLE) fdr_cut, count(*) FILTER (x) n, count(*) FILTER (x AND v > 0) n_up, count(*) FILTER (x AND v < 0) n_dw FROM (SELECT l_returnflag, lfc_cut, fdr_cut, l_discount - 0.05 v, abs(l_discount - 0.05) >= CAST(lfc_cut AS DOUBLE) AND l_tax < CAST(fdr_cut AS DOUBLE) x FROM lineitem, g) GROUP BY ALL")
def threshold_grid(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_discount") - 0.05).alias("v"), "l_tax")
    return filters.threshold_counts(li, ["l_returnflag"], "v", "l_tax", [0.02, 0.05, 0.08], [0.02, 0.04, 0.06])


@query("substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_type), 'steel') OR NOT contains(lower(p_name), 'a')")
def substring_filter(spark, sf):
    return table(spark, sf, "part").where(filters.contains_ci("p_type", "STEEL") | filters.contains_ci("p_name", "A", negate=True)).select("p_partkey", "p_name")


@query("regex_any_column", "SELECT p_partkey FROM part WHERE regexp_matches(coalesce(p_name, ''), '(?i)^g|e$') OR regexp_matches(coalesce(nullif(p_brand, 'Brand#11'), ''), '(?i)^g|e$') OR regexp_matches(coalesce(p_type, ''), '(?i)^g|e$')")
def regex_any_column(spark, sf):
    p = table(spark, sf, "part").withColumn("p_brand", F.nullif("p_brand", F.lit("Brand#11")))
    return p.where(filters.any_rlike(["p_name", "p_brand", "p_type"], "^g|e$")).select("p_partkey")


@query("semi_anti", "SELECT 'in' side, count(*) n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT 'out', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_anti(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    side = lambda neg, name: filters.members(c, o, ["c_custkey"], neg).agg(F.lit(name).alias("side"), F.count("*").alias("n"))
    return side(False, "in").union(side(True, "out"))


@query("flag_prefix", "SELECT CASE WHEN c_acctbal >= 6000 OR c_nationkey >= 20 THEN 'N-' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS c_custkey FROM customer")
def flag_prefix(spark, sf):
    return filters.flagged_ids(table(spark, sf, "customer"), "c_custkey", (F.col("c_acctbal") >= 6000) | (F.col("c_nationkey") >= 20)).select("c_custkey")


@query("expressed_genes", "SELECT l_partkey, count(*) n FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING avg(CASE WHEN l_quantity >= 10 THEN 1.0 ELSE 0.0 END) >= 0.9) OR l_partkey <= 5 GROUP BY 1")
def expressed_genes(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    forced = table(spark, sf, "part").where("p_partkey <= 5").select(F.col("p_partkey").alias("l_partkey"))
    return filters.expressed(li, "l_partkey", "l_quantity", 10, 0.9, forced).groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("filter_sweep", "WITH p AS (SELECT l_partkey, median(l_quantity) med, avg(CASE WHEN l_discount >= 0.03 THEN 1.0 ELSE 0.0 END) s0, avg(CASE WHEN l_discount >= 0.06 THEN 1.0 ELSE 0.0 END) s1 FROM lineitem GROUP BY 1) SELECT s min_share, CAST(c AS DOUBLE) min_count, (SELECT count(*) FROM p WHERE (CASE WHEN s < 0.05 THEN s0 ELSE s1 END) >= 0.5 AND med >= c) n_genes FROM (VALUES (0.03::DOUBLE), (0.06::DOUBLE)) a(s), (VALUES (20), (26)) b(c)")
def filter_sweep(spark, sf):
    return filters.filter_sweep(table(spark, sf, "lineitem").select("l_partkey", "l_discount", "l_quantity"), "l_partkey", "l_discount", "l_quantity", [0.03, 0.06], [20, 26])


@query("col_mean_outliers", "WITH m AS (SELECT l_suppkey, avg(l_quantity) m FROM lineitem GROUP BY 1), b AS (SELECT avg(m) c, stddev_pop(m) s FROM m) SELECT l_suppkey, count(*) n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM m, b WHERE m <= c + s AND (c - s <= 0 OR m >= c - s)) GROUP BY 1")
def col_mean_outliers(spark, sf):
    return filters.column_outliers(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", 1.0).groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("tukey_outliers", "WITH q AS (SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.25), 2) q1, round(quantile_cont(o_totalprice, 0.5), 2) q2, round(quantile_cont(o_totalprice, 0.75), 2) q3 FROM orders GROUP BY 1) SELECT o_orderpriority, count(*) n FROM orders JOIN q USING (o_orderpriority) WHERE q1 = q2 OR q2 = q3 OR o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1")
def tukey_outliers(spark, sf):
    return filters.without_tukey_outliers(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("regex_drop", "SELECT p_type, count(*) n FROM part WHERE NOT regexp_matches(p_brand, '^(Brand#1|Brand#2)') GROUP BY 1")
def regex_drop(spark, sf):
    return filters.without_pattern(table(spark, sf, "part"), "p_brand", "Brand#1|Brand#2").groupBy("p_type").agg(F.count("*").alias("n"))


@query("pathway_modulation", "WITH p AS (SELECT p_brand, coalesce(avg(l_discount) FILTER (l_returnflag = 'A'), 0) a, coalesce(avg(l_discount) FILTER (l_returnflag = 'R'), 0) r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, round(a, 6) \"A\", round(r, 6) \"R\", round(r - a, 6) diff, round(abs(r - a), 6) abs_diff FROM p WHERE abs(r - a) >= 0.0003 AND r - a >= 0.0003")
def pathway_modulation(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    m = filters.pathway_modulation(d, "p_brand", "l_returnflag", "l_discount", "A", "R", 0.0003, False, "up")
    return m.select("p_brand", *[_r(c).alias(c) for c in ("A", "R", "diff", "abs_diff")])


@query("assoc_like_search", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(coalesce(n_name, '')), '1') OR contains(lower(coalesce(r_name, '')), 'asia') OR contains(lower(coalesce(r_name, '')), 'eu')")
def assoc_like_search(spark, sf):
    j = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return j.where(S.any_like("n_name", ["1"]) | S.any_like("r_name", ["ASIA", "EU"])).select("n_name", "r_name")


@query("array_theta_join", "WITH m AS (SELECT s_nationkey moa, list(DISTINCT s_suppkey) s, list(DISTINCT p_size) z FROM supplier JOIN part ON p_partkey % 25 = s_nationkey GROUP BY 1) SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, coalesce(moa, -1) moa FROM (SELECT l_suppkey, l_partkey, l_linenumber, l_orderkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey) t LEFT JOIN m ON list_contains(s, l_suppkey) AND list_contains(z, p_size)")
def array_theta_join(spark, sf):
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("moa")).agg(F.collect_set("s_suppkey").alias("s"))
    z = table(spark, sf, "part").groupBy((F.col("p_partkey") % 25).alias("moa")).agg(F.collect_set("p_size").alias("z"))
    m = s.join(z, "moa")  # each side is a set already: joined row by row, a nation would have suppliers times parts
    t = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", "p_size")
    return joins.array_containment(t, m, ["l_suppkey", "p_size"], ["s", "z"], "moa").select("l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", F.coalesce("moa", F.lit(-1)).alias("moa"))


@query("unnest_left", "SELECT p_partkey, w FROM (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN [] ELSE string_split(p_name, ' ') END a FROM part) LEFT JOIN LATERAL (SELECT unnest(a) w) ON true")
def unnest_left(spark, sf):
    a = F.when(F.col("p_size") % 7 == 0, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return table(spark, sf, "part").select("p_partkey", F.explode_outer(a).alias("w"))


@query("score_limit", "SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, nullif(o_totalprice, 0) o_totalprice FROM orders) ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def score_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.nullif("o_totalprice", F.lit(0.0)).alias("o_totalprice")).orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(50)


@query("outer_fold", "WITH a AS (SELECT o_custkey, sum(o_totalprice) s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, sum(o_totalprice) s FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), c AS (SELECT o_custkey, sum(o_totalprice) s FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_custkey, round(coalesce(a.s, 0), 2) \"F\", round(coalesce(b.s, 0), 2) \"O\", round(coalesce(c.s, 0), 2) \"P\" FROM a FULL JOIN b USING (o_custkey) FULL JOIN c USING (o_custkey)")
def outer_fold(spark, sf):
    o = table(spark, sf, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(_r(F.sum("o_totalprice"), 2).alias(s))
    return joins.outer_fold([part("F"), part("O"), part("P")], ["o_custkey"])


@query("wide_by_sample", "WITH r AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_type IN ('click', 'view', 'purchase')), e AS (SELECT user_id FROM r GROUP BY 1 HAVING count(*) > 2) SELECT user_id, CAST(max(CASE WHEN event_type = 'click' THEN n END) AS BIGINT) click, CAST(max(CASE WHEN event_type = 'view' THEN n END) AS BIGINT) \"view\", CAST(max(CASE WHEN event_type = 'purchase' THEN n END) AS BIGINT) purchase FROM (SELECT user_id, event_type, count(*) n FROM events WHERE user_id IN (SELECT user_id FROM e) GROUP BY 1, 2) GROUP BY 1")
def wide_by_sample(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return joins.wide_by_sample(e, ["user_id"], "event_type", "n", ["click", "view", "purchase"], 0.75)


@query("interval_overlap", "WITH i AS (SELECT o_orderkey id, o_custkey, epoch(o_orderdate)::BIGINT // 86400 s FROM orders) SELECT a.id, b.id id_b, a.o_custkey FROM i a JOIN i b ON a.o_custkey = b.o_custkey AND a.id < b.id AND a.s < b.s + 30 AND b.s < a.s + 30")
def interval_overlap(spark, sf):
    day = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    i = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", day.alias("start"), (day + 30).alias("end"))
    return joins.overlaps(i, i, ["o_custkey"], width=64).where("id < id_b").select("id", "id_b", "o_custkey")


@query("antisense", "WITH g AS (SELECT l_orderkey || '.' || l_linenumber id, l_suppkey chrom, l_partkey * 10 s, l_partkey * 10 + CAST(l_quantity AS BIGINT) e, CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END strand FROM lineitem) SELECT DISTINCT regexp_replace(unnest([a.id, b.id]), '\\..*$', '') id FROM g a JOIN g b ON a.chrom = b.chrom AND a.strand = '+' AND b.strand = '-' AND least(a.e, b.e) - greatest(a.s, b.s) >= 5")
def antisense(spark, sf):
    g = table(spark, sf, "lineitem").select(F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), F.col("l_suppkey").alias("chrom"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end"), F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("strand"))
    return joins.antisense_ids(g, 5)


@query("aligned_fill", "SELECT n_nationkey, n_name, round(coalesce(b, 0), 2) b FROM nation LEFT JOIN (SELECT s_nationkey, sum(s_acctbal) b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) ON n_nationkey = s_nationkey")
def aligned_fill(spark, sf):
    v = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(_r(F.sum("s_acctbal"), 2).alias("b"))
    return joins.aligned(table(spark, sf, "nation").select("n_nationkey", "n_name"), v, "n_nationkey")


@query("bridge_repair", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def bridge_repair(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("X"), F.col("s_nationkey").cast("string")).alias("k"))
    b = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("k"))
    return joins.bridged(s, b, "k").select("s_suppkey")


@query("two_conditions", "WITH a AS (SELECT l_partkey k, avg(l_discount) - 0.05 v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), r AS (SELECT l_partkey k, avg(l_discount) - 0.05 v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT k, round(coalesce(a.v, 0), 6) + 0 v1, round(coalesce(r.v, 0), 6) + 0 v2, coalesce(a.v, 0) * coalesce(r.v, 0) < 0 exchange_sign, round(coalesce(r.v, 0) - coalesce(a.v, 0), 6) + 0 diff FROM a FULL JOIN r USING (k)")
def two_conditions(spark, sf):
    d = A.placed(table(spark, sf, "lineitem")).withColumnRenamed("l_partkey", "k")
    v = lambda f: A.mean_in_order(d.where(F.col("l_returnflag") == f), ["k"], "l_discount", "place", "m").select("k", (F.col("m") - 0.05).alias("v"))
    return joins.two_conditions(v("A"), v("R"), "k", "v").select("k", _r("v1").alias("v1"), _r("v2").alias("v2"), "exchange_sign", _r("diff").alias("diff"))


@query("alias_resolution", "WITH n AS (SELECT DISTINCT p_name name FROM part), al AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) alias, p_type symbol FROM part), one AS (SELECT upper(alias) u, min(symbol) t FROM (SELECT DISTINCT upper(alias) alias, symbol FROM al) GROUP BY 1 HAVING count(*) = 1), r AS (SELECT name, CASE WHEN name IN (SELECT symbol FROM al) THEN name ELSE t END s FROM n LEFT JOIN one ON upper(name) = u) SELECT name, CASE WHEN count(*) OVER (PARTITION BY s) = 1 THEN s END symbol FROM r")
def alias_resolution(spark, sf):
    p = table(spark, sf, "part")
    return joins.resolved_aliases(p.select(F.col("p_name").alias("name")).distinct(), p.select(F.explode(F.split("p_name", " ")).alias("alias"), F.col("p_type").alias("symbol")).distinct())


@query("overlap_flag", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) has FROM customer")
def overlap_flag(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.membership_flag(table(spark, sf, "customer").select("c_custkey"), o, "c_custkey", "has")


@query("nation_pairs", "SELECT a.n_nationkey a, b.n_nationkey b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def nation_pairs(spark, sf):
    return joins.pairs(table(spark, sf, "nation"), "n_nationkey")


@query("shard_pruning", "WITH i AS (SELECT l_suppkey shard, min(l_partkey) lo, max(l_partkey) hi FROM lineitem WHERE l_quantity > 49 GROUP BY 1) SELECT shard FROM i WHERE EXISTS (SELECT 1 FROM part WHERE p_size = 1 AND p_partkey BETWEEN lo AND hi)")
def shard_pruning(spark, sf):
    i = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("shard")).agg(F.min("l_partkey").alias("lo"), F.max("l_partkey").alias("hi"))
    return joins.covering_shards(table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("value")), i)


@query("dropna_groupby", "SELECT t event_type, count(*) n FROM (SELECT nullif(event_type, 'error') t FROM events) WHERE t IS NOT NULL GROUP BY 1")
def dropna_groupby(spark, sf):
    return A.counts(table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type")), ["event_type"], True)


@query("keepna_groupby", "SELECT nullif(event_type, 'error') event_type, count(*) n FROM events GROUP BY 1")
def keepna_groupby(spark, sf):
    return A.counts(table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("event_type")), ["event_type"])


@query("nonnull_count", "SELECT event_type, count(CASE WHEN value > 50 THEN value END) n FROM events GROUP BY 1")
def nonnull_count(spark, sf):
    return A.filled_counts(table(spark, sf, "events").withColumn("v", F.when(F.col("value") > 50, F.col("value"))), "event_type", "v")


@query("direction_by_class", "SELECT CASE WHEN v > 1 THEN 'up' WHEN v < -1 THEN 'down' ELSE 'neutral' END direction, c, count(*) n FROM (SELECT (l_quantity - 25) / 10 v, CASE WHEN contains(lower(p_type), 'steel') THEN 'coding' WHEN contains(lower(p_type), 'eco') OR contains(lower(p_type), 'tin') THEN 'noncoding' ELSE 'other' END c FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2")
def direction_by_class(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = (F.col("l_quantity") - 25) / 10
    return d.groupBy(S.direction(v, 1, "up", "down", "neutral").alias("direction"), S.first_class(F.lower("p_type"), {"coding": ["steel"], "noncoding": ["eco", "tin"]}).alias("c")).agg(F.count("*").alias("n"))


@query("gene_support", "SELECT l_partkey, n FROM (SELECT l_partkey, count(DISTINCT s_nationkey) n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), (SELECT count(DISTINCT s_nationkey) t FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) WHERE n >= floor(t * 0.75) + 1")
def gene_support(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey")
    return A.supported(d, ["l_partkey"], "s_nationkey", 0.75)


@query("dedup_keep_max", "SELECT l_partkey, max(l_extendedprice) l_extendedprice FROM lineitem GROUP BY 1")
def dedup_keep_max(spark, sf):
    li = table(spark, sf, "lineitem")
    return A.best_rows(li, ["l_partkey"], [F.desc("l_extendedprice"), *[F.col(c) for c in li.columns]]).select("l_partkey", "l_extendedprice")


@query("dedup_keep_blank", "WITH e AS (SELECT event_id, nullif(event_type, 'error') t, value FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY value DESC, event_id) k FROM e WHERE t IS NOT NULL) SELECT event_id, t FROM r WHERE k = 1 UNION ALL SELECT event_id, t FROM e WHERE t IS NULL")
def dedup_keep_blank(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("t"), "value")
    return A.best_rows(e, ["t"], [F.desc("value"), F.col("event_id")], True).select("event_id", "t")


@query("pseudobulk", "WITH b AS (SELECT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 4) SELECT s_nationkey, l_returnflag, round(sum(l_quantity), 2) l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey IN (SELECT * FROM b) GROUP BY 1, 2")
def pseudobulk(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return A.pseudobulk(d, ["s_nationkey"], "l_suppkey", "l_returnflag", "l_quantity", 4).withColumn("l_quantity", _r("l_quantity", 2))


@query("hash_sample")
def hash_sample(spark, sf):
    return A.hash_sample(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", 30).select("c_mktsegment", "c_custkey")


@query("binary_pivot", "WITH e AS (SELECT DISTINCT trim(CAST(user_id AS VARCHAR)) u, trim(json_extract_string(props, '$.k')) k FROM events), a AS (SELECT * FROM e WHERE u IN (SELECT u FROM e GROUP BY 1 HAVING count(*) >= 40)), b AS (SELECT * FROM a WHERE k IN (SELECT k FROM a GROUP BY 1 HAVING count(*) >= 50)) SELECT u, k FROM b")
def binary_pivot(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("u"), F.get_json_object("props", "$.k").alias("k"))
    return A.presence(e, "u", "k", 40, 50)


@query("presence_matrix", "SELECT user_id, CAST(max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS INT) click, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) error FROM events GROUP BY 1")
def presence_matrix(spark, sf):
    return A.presence_matrix(table(spark, sf, "events").select("user_id", "event_type"), "user_id", "event_type", ["click", "error"])


@query("eav_pivot", "SELECT o_custkey, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END) \"1-urgent\", min(CASE WHEN o_orderpriority = '5-LOW' THEN o_orderstatus END) \"5-low\" FROM orders GROUP BY 1")
def eav_pivot(spark, sf):
    return A.attribute_pivot(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus", ["1-URGENT", "5-LOW"])


@query("mean_pivot", "SELECT p_brand, round(avg(l_discount) FILTER (l_returnflag = 'A'), 6) a, round(avg(l_discount) FILTER (l_returnflag = 'N'), 6) n, round(avg(l_discount) FILTER (l_returnflag = 'R'), 6) r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def mean_pivot(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return A.mean_pivot(d, "p_brand", "l_returnflag", "l_discount", ["A", "N", "R"]).select("p_brand", *[_r(c).alias(c.lower()) for c in ("A", "N", "R")])


@query("crosstab", "SELECT l_returnflag, l_linestatus, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) share FROM lineitem GROUP BY 1, 2")
def crosstab(spark, sf):
    return A.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", True).withColumn("share", _r("share"))


@query("cpm_log2", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) * 1e6, 4) cpm, round(log2(l_quantity / sum(l_quantity) OVER (PARTITION BY l_suppkey) * 1e6 + 1), 6) log_cpm FROM lineitem")
def cpm_log2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return A.per_million(li, "l_suppkey", "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", _r("cpm", 4).alias("cpm"), _r("log_cpm").alias("log_cpm"))


@query("topvar", "SELECT l_partkey, round(var_samp(l_extendedprice), 2) variance FROM lineitem GROUP BY 1 ORDER BY var_samp(l_extendedprice) DESC NULLS LAST, 1 LIMIT 50")
def topvar(spark, sf):
    return A.most_variable(table(spark, sf, "lineitem"), "l_partkey", "l_extendedprice", 50).select("l_partkey", _r("variance", 2).alias("variance"))


@query("tumour_qc", "WITH r AS (SELECT l_suppkey, l_quantity q, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey * 10 + l_linenumber) k FROM (SELECT l_suppkey, l_orderkey, l_linenumber, greatest(max(l_quantity) - 10, 0) l_quantity FROM lineitem GROUP BY 1, 2, 3)) SELECT l_suppkey, round(sum(q), 2) library, count(*) FILTER (q > 0) n_detected, round(avg(CASE WHEN q = 0 THEN 1.0 ELSE 0 END), 6) frac_zero, median(CASE WHEN q > 0 THEN q END) median_nonzero, round(sum(q) FILTER (k <= 50) / sum(q), 6) top_share FROM r GROUP BY 1")
def tumour_qc(spark, sf):
    x = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey", "l_linenumber").agg(F.greatest(F.max("l_quantity") - 10, F.lit(0.0)).alias("q")).withColumn("g", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return A.tumour_qc(x, "l_suppkey", "g", "q").select("l_suppkey", _r("library", 2).alias("library"), "n_detected", _r("frac_zero").alias("frac_zero"), "median_nonzero", _r("top_share").alias("top_share"))


@query("venn_regions", "SELECT mask, count(*) n FROM (SELECT o_custkey, bit_or(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END)::BIGINT mask FROM orders GROUP BY 1) GROUP BY 1")
def venn_regions(spark, sf):
    return A.regions(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query("describe_groups", "SELECT c_mktsegment, count(*) n, round(avg(c_acctbal), 6) mean, round(stddev_pop(c_acctbal), 6) std, min(c_acctbal) min, max(c_acctbal) max, round(quantile_cont(c_acctbal, 0.25), 6) q1, round(quantile_cont(c_acctbal, 0.5), 6) median, round(quantile_cont(c_acctbal, 0.75), 6) q3, round(stddev_pop(c_acctbal) / sqrt(count(*)), 6) sem, round(stddev_pop(c_acctbal) / abs(avg(c_acctbal)), 6) vc FROM customer GROUP BY 1")
def describe_groups(spark, sf):
    d = A.describe(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal")
    return d.select("c_mktsegment", "n", "min", "max", *[_r(c).alias(c) for c in ("mean", "std", "q1", "median", "q3", "sem", "vc")])


@query("panel_explode", "SELECT w, count(*) n, round(avg(p_retailprice), 4) mean FROM (SELECT unnest(string_split(replace(p_name, ' ', ','), ',')) w, p_retailprice FROM part) GROUP BY 1")
def panel_explode(spark, sf):
    p = table(spark, sf, "part").withColumn("w", F.replace("p_name", F.lit(" "), F.lit(",")))
    return A.panel_members(p, "w").groupBy("w").agg(F.count("*").alias("n"), _r(F.avg("p_retailprice"), 4).alias("mean"))


@query("share_of_total", "SELECT n_regionkey, n_nationkey, round(b / sum(b) OVER (PARTITION BY n_regionkey), 6) share FROM (SELECT n_regionkey, n_nationkey, sum(abs(c_acctbal)) b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)")
def share_of_total(spark, sf):
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.sum(F.abs("c_acctbal")).alias("b"))
    return A.share_of_total(d, ["n_regionkey"], "b").select("n_regionkey", "n_nationkey", _r("share").alias("share"))


@query("strandedness", "SELECT l_suppkey, CASE WHEN r > 5 THEN 'first' WHEN r < 0.2 THEN 'second' ELSE 'unstranded' END s FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) / nullif(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 0) r FROM lineitem GROUP BY 1)")
def strandedness(spark, sf):
    side = lambda f: F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(A.strandedness(side("A"), side("R")).alias("s"))


@query("first_best", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount >= l_tax THEN 'l_discount' ELSE 'l_tax' END best FROM lineitem")
def first_best(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", A.first_best(["l_discount", "l_tax"]).alias("best"))


@query("concat_pivot", "SELECT p_brand, coalesce(string_agg(p_name, '' ORDER BY p_name) FILTER (p_size = 1), '') \"1\", coalesce(string_agg(p_name, '' ORDER BY p_name) FILTER (p_size = 2), '') \"2\" FROM part GROUP BY 1")
def concat_pivot(spark, sf):
    return A.concat_pivot(table(spark, sf, "part").select("p_brand", "p_size", "p_name"), "p_brand", "p_size", "p_name", [1, 2])


@query("union_distinct", "SELECT n_nationkey k FROM nation UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf):
    return sets.union_distinct([table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"))])


@query("tagged_union", "SELECT c_name AS name, CAST(c_custkey AS BIGINT) AS c_custkey, -1::BIGINT AS s_suppkey, 'c' AS source FROM customer UNION ALL SELECT s_name, -1, s_suppkey, 's' FROM supplier")
def tagged_union(spark, sf):
    return sets.union_all([table(spark, sf, "customer").select(F.col("c_name").alias("name"), "c_custkey"), table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")], ["c", "s"]).fillna(-1, ["c_custkey", "s_suppkey"])


@query("common_keys", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def common_keys(spark, sf):
    o = table(spark, sf, "orders")
    return sets.common([o.where(F.col("o_orderstatus") == s) for s in "FOP"], "o_custkey")


@query("upsert", "SELECT n_nationkey, n_regionkey, n_name FROM nation WHERE NOT (n_regionkey = 2 AND n_nationkey % 2 = 0) UNION ALL SELECT n_nationkey, n_regionkey, 'new' FROM nation WHERE n_regionkey = 2 AND n_nationkey % 2 = 0")
def upsert(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name")
    return sets.upsert(n, n.where("n_regionkey = 2 and n_nationkey % 2 = 0").withColumn("n_name", F.lit("new")), ["n_nationkey", "n_regionkey"])


@query("column_profile", "SELECT 'c_nationkey' \"column\", count(DISTINCT c_nationkey) n_distinct, count(c_nationkey) n, min(CAST(c_nationkey AS VARCHAR)) min, max(CAST(c_nationkey AS VARCHAR)) max FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer")
def column_profile(spark, sf):
    return src.column_profile(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


@query("numeric_profile", "SELECT min(c_acctbal) min, max(c_acctbal) max, round(avg(c_acctbal), 6) mean, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END), 6) frac_neg, count(DISTINCT c_acctbal) n_distinct, avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) > 0.2 AND avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0 END) < 0.8 signed FROM customer")
def numeric_profile(spark, sf):
    return src.numeric_profile(table(spark, sf, "customer"), "c_acctbal").withColumns({"mean": _r("mean"), "frac_neg": _r("frac_neg")})


@query("long_nonzero", "SELECT c_custkey, 'neg' f, CAST(1 AS INT) v FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'rich', 1 FROM customer WHERE c_acctbal > 9000")
def long_nonzero(spark, sf):
    wide = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") < 0).cast("int").alias("neg"), (F.col("c_acctbal") > 9000).cast("int").alias("rich"))
    return src.long_nonzero(wide, "c_custkey", "f", "v")


_WANTED = (3, 17, 18, 44)


@query("atlas_scan", f"""WITH l AS (SELECT l_returnflag, l_linestatus, CAST(l_extendedprice AS DOUBLE) p, l_quantity q, CAST(l_quantity - 1 AS BIGINT) // 5 s FROM lineitem),
n AS (SELECT count(DISTINCT s) a, count(DISTINCT CASE WHEN q IN {_WANTED} THEN s END) b FROM l)
SELECT l_returnflag, round(avg(p) FILTER (l_linestatus = 'F'), 4) "F", round(avg(p) FILTER (l_linestatus = 'O'), 4) "O", any_value(CAST(a AS INTEGER)) n_files, any_value(CAST(b AS INTEGER)) n_read FROM l, n WHERE q IN {_WANTED} AND p > 100 GROUP BY 1""")
def atlas_scan(spark, sf):
    """Line items dealt to a file for every five quantities: mean prices of some quantities, from the files that hold them."""
    from larkspan.operators.lineage import Steps
    from larkspan.sources import atlas

    at = Steps(spark).path
    lines = table(spark, sf, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("double")).withColumn("shard", F.floor((F.col("l_quantity") - 1) / 5).cast("int"))
    lines.repartition("shard").write.partitionBy("shard").parquet(f"{at}/shards")
    wanted = spark.createDataFrame([(float(v),) for v in _WANTED], "value double")
    out, report = atlas.atlas(spark, f"{at}/shards", f"{at}/index", "l_quantity", wanted, "double", F.col("l_extendedprice") > 100, "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"])
    return out.crossJoin(F.broadcast(report)).select("l_returnflag", F.round("F", 4).alias("F"), F.round("O", 4).alias("O"), "n_files", "n_read")  # one row of counts


@query("hash_sample_counts", "SELECT c_mktsegment, least(count(*), 30) n FROM customer GROUP BY 1")
def hash_sample_counts(spark, sf):
    return hash_sample(spark, sf).groupBy("c_mktsegment").agg(F.count("*").alias("n"))
