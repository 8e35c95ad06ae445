"""Evidence, planning, ledgers and graphs."""

from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.operators import evidence as E
from larkspan.operators import graph as G
from larkspan.plans.registry import query, table


def _r(c, n=6):
    return F.round(c, n)


def _items(spark, sf):
    """Orders as evidence: the customer's nation is the hypothesis, priority the class."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "literature").when(F.col("o_orderstatus") == "O", "own_omics").otherwise("wetlab")
    return o.select(F.col("c_nationkey").alias("hid"), kind.alias("kind"), F.col("o_orderpriority").alias("independence_class"), (0.5 + F.col("o_totalprice") / 100000).alias("raw_lr"), F.lit(None).cast("double").alias("reliability"), F.lit(1.0).alias("field_penalty"), F.lit(False).alias("decisive"))


_LR = """i AS (SELECT c_nationkey hid, CASE o_orderstatus WHEN 'F' THEN 'literature' WHEN 'O' THEN 'own_omics' ELSE 'wetlab' END kind, o_orderpriority cls, 0.5 + o_totalprice / 100000 x FROM orders JOIN customer ON o_custkey = c_custkey),
e AS (SELECT *, CASE kind WHEN 'literature' THEN 0.9 ELSE 0.95 END r, CASE kind WHEN 'literature' THEN 0.8 WHEN 'own_omics' THEN 0.6 ELSE 0.35 END rho FROM i),
l AS (SELECT hid, kind, cls, rho, sum(ln(CASE WHEN x >= 1 THEN x / (r + (1 - r) * x) ELSE r * x + 1 - r END)) s, count(*) n FROM e GROUP BY ALL),
a AS (SELECT hid, sum(s / (1 + rho * (n - 1))) log_lr, CAST(sum(n) AS BIGINT) n_items FROM l GROUP BY 1)"""


@query("loglr_aggregate", f"WITH {_LR} SELECT hid, round(log_lr, 6) log_lr, n_items FROM a")
def loglr_aggregate(spark, sf):
    return E.aggregate_log_lr(_items(spark, sf)).withColumn("log_lr", _r("log_lr"))


@query("posterior", f"WITH {_LR} SELECT hid, round(1 / (1 + exp(-(-2 + log_lr))), 6) posterior FROM a")
def posterior(spark, sf):
    return E.aggregate_log_lr(_items(spark, sf)).select("hid", _r(E.posterior(F.lit(-2.0), F.col("log_lr"))).alias("posterior"))


@query("adjudication", f"WITH {_LR}, t AS (SELECT l_suppkey % 25 hid, count(DISTINCT CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 7 END) n, max(CASE WHEN l_orderkey % 15000 = 1 THEN 1 ELSE 0 END) b FROM lineitem GROUP BY 1), p AS (SELECT n_nationkey hid, 1 / (1 + exp(-(-2 + log_lr))) p, CASE WHEN n_regionkey = 0 THEN 'proposed' ELSE 'under_test' END st, n, b, n_nationkey % 3 = 0 AND n_nationkey < 12 f FROM nation LEFT JOIN a ON hid = n_nationkey LEFT JOIN t USING (hid)) SELECT hid, CASE WHEN st = 'proposed' THEN st WHEN f OR coalesce(b, 0) = 1 OR p <= 0.05 THEN 'refuted' WHEN p < 0.9 OR coalesce(n, 0) < 2 THEN 'under_test' ELSE 'surviving' END state FROM p")
def adjudication(spark, sf):
    n = table(spark, sf, "nation")
    h = n.select(F.col("n_nationkey").alias("hid"), F.when(F.col("n_regionkey") == 0, "proposed").otherwise("under_test").alias("state"), F.lit("causal").alias("claim"), F.lit(-2.0).alias("prior_log_odds"))
    p = n.select(F.col("n_nationkey").alias("hid"), (F.col("n_nationkey") % 3 == 0).alias("critical"), F.lit(">=").alias("operator"), F.lit(12.0).alias("threshold"), F.col("n_nationkey").cast("double").alias("observed"))
    t = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).cast("int").alias("hid"), (F.col("l_partkey") % 7).alias("actor"), F.lit(0).alias("independent_of"), (F.col("l_orderkey") % 15000 == 1).alias("succeeded"))
    return E.adjudicated(h, _items(spark, sf), p, t).select("hid", "state")


@query("eig", "WITH x AS (SELECT c_custkey, 0.01 + 0.98 * (c_custkey % 97) / 97.0::DOUBLE p, 0.8::DOUBLE se, 0.85::DOUBLE sp FROM customer), y AS (SELECT *, p * se + (1 - p) * (1 - sp) q FROM x), z AS (SELECT *, p * se / q a, p * (1 - se) / (1 - q) b FROM y) SELECT c_custkey, round(greatest(-(p * log2(p) + (1 - p) * log2(1 - p)) - (q * -(a * log2(a) + (1 - a) * log2(1 - a)) + (1 - q) * -(b * log2(b) + (1 - b) * log2(1 - b))), 0), 6) bits FROM z")
def eig(spark, sf):
    p = 0.01 + 0.98 * (F.col("c_custkey") % 97) / 97
    return table(spark, sf, "customer").select("c_custkey", _r(S.information_gain(p, F.lit(0.8), F.lit(0.85))).alias("bits"))


@query("assay_plan")
def assay_plan(spark, sf):
    post = E.aggregate_log_lr(_items(spark, sf)).select("hid", E.posterior(F.lit(-2.0), F.col("log_lr")).alias("posterior"))
    h = post.withColumns({"state": F.lit("under_test"), "claim": F.lit("causal"), "primary": F.lit(False), "intervened": F.lit(False), "mechanism": (F.col("hid") % 3).cast("string"), "scale": (F.col("hid") % 2).cast("string")})
    assays = spark.createDataFrame([("a1", "wetlab", 0.8, 0.85, 900.0, [], True, True), ("a2", "own_omics", 0.7, 0.7, 200.0, [], False, True), ("a3", "clinical", 0.5, 0.5, 100.0, [], False, True)], "aid string, kind string, sensitivity double, specificity double, cost double, applicable_to array<int>, identifies_causal boolean, feasible boolean")
    chosen = E.plan(E.candidates(h, assays), 5000.0)
    return spark.createDataFrame([(r["hid"], r["aid"], r["slot"]) for r in chosen], "hid int, aid string, slot string")


@query("deg_evidence", "WITH d AS (SELECT p_brand, (avg(l_discount) - 0.05) * 100 f, count(*) n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT p_brand, n, round(0.95::DOUBLE * 0.55 * 0.75, 6) reliability FROM d")
def deg_evidence(spark, sf):
    d = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(((F.avg("l_discount") - 0.05) * 100).alias("log2fc"), F.count("*").alias("n"))
    d = d.withColumns({"padj": F.lit(0.01), "n_a": F.lit(10), "n_b": F.lit(12), "expected": F.lit("up"), "composition_adjusted": F.lit(False), "purity_adjusted": F.lit(False), "dataset": F.lit("d"), "contrast": F.lit("c")})
    return E.deg_evidence(d).select("p_brand", "n", _r("reliability").alias("reliability"))


@query("ledger_tampered", "SELECT user_id, count(*) FILTER (event_id % 97 = 0) n_payload, count(*) FILTER (event_id % 97 <> 0) * 0 n_other FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 97 = 0) > 0")
def ledger_tampered(spark, sf):
    """A ledger in which the payload of every 97th event was changed after it was sealed: just those are told."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.col("props").alias("payload"), "event_type")
    changed = E.sealed(e, ["seq", "event_type"]).withColumn("payload", F.when(F.col("seq") % 97 == 0, F.concat(F.coalesce("payload", F.lit("")), F.lit(" "))).otherwise(F.col("payload")))
    faults = E.ledger_faults(changed, ["seq", "event_type"])
    return faults.groupBy(F.col("chain").alias("user_id")).agg(F.count_if((F.col("fault") == "payload") & (F.col("seq") % 97 == 0)).alias("n_payload"), F.count_if((F.col("fault") != "payload") | (F.col("seq") % 97 != 0)).alias("n_other"))


@query("ledger_first", "SELECT user_id, min(event_id) seq, arg_min(event_type, event_id) kind FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def ledger_first(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return E.first_of(e, ["click", "purchase"], by="user_id")


@query("ledger_export", "SELECT event_id seq, event_type kind, user_id subject FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def ledger_export(spark, sf):
    """One subject's events, as they come back from the exported ledger."""
    from larkspan.operators.lineage import Steps
    from larkspan.sources.tables import json_lines

    at = Steps(spark).path
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("subject"))
    E.export_ledger(e, at)
    first = e.agg(F.min("subject")).first()[0]
    return E.for_subject(json_lines(spark, at, "seq long, kind string, subject long"), first)


@query("ledger_verify", "SELECT user_id, count(*) n, 0::BIGINT n_faults FROM events GROUP BY 1")
def ledger_verify(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("chain"), F.col("event_id").alias("seq"), F.col("props").alias("payload"), "event_type")
    sealed = E.sealed(e, ["seq", "event_type"])
    faults = E.ledger_faults(sealed, ["seq", "event_type"]).groupBy("chain").agg(F.count("*").alias("f"))
    n = sealed.groupBy("chain").agg(F.count("*").alias("n"))
    return n.join(faults, "chain", "left").select(F.col("chain").alias("user_id"), "n", F.coalesce("f", F.lit(0)).alias("n_faults"))


def _edges(spark, sf):
    """Nations to nations: who sells to whom, by hash of the order."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").cast("long").alias("src"), ((F.col("o_orderkey") / 400).cast("long") % 31).alias("dst")).where("src <> dst").distinct()


_EDGE = "e AS (SELECT DISTINCT c_nationkey::BIGINT src, (o_orderkey // 400) % 31 dst FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> (o_orderkey // 400) % 31)"


@query("graph_hubs", f"WITH {_EDGE} SELECT id, count(*) degree FROM (SELECT src id FROM e UNION ALL SELECT dst FROM e) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def graph_hubs(spark, sf):
    return G.hubs(_edges(spark, sf), 5)


@query("sources_sinks", f"WITH {_EDGE} SELECT id, 'source' kind FROM (SELECT src id FROM e EXCEPT SELECT dst FROM e) UNION ALL SELECT id, 'sink' FROM (SELECT dst id FROM e EXCEPT SELECT src FROM e)")
def sources_sinks(spark, sf):
    e = _edges(spark, sf)
    return G.sources(e).withColumn("kind", F.lit("source")).union(G.sinks(e).withColumn("kind", F.lit("sink")))


@query("upstream_downstream", f"WITH {_EDGE} SELECT DISTINCT src id, 'up' side FROM e WHERE dst IN (3, 7) UNION ALL SELECT DISTINCT dst, 'down' FROM e WHERE src IN (3, 7)")
def upstream_downstream(spark, sf):
    e, n = _edges(spark, sf), spark.createDataFrame([(3,), (7,)], "id long")
    return G.upstream(e, n).withColumn("side", F.lit("up")).union(G.downstream(e, n).withColumn("side", F.lit("down")))


@query("induced_edges", f"WITH {_EDGE} SELECT src, dst FROM e WHERE src % 2 = 0 AND dst % 2 = 0")
def induced_edges(spark, sf):
    e = _edges(spark, sf)
    return G.induced(e, e.select(F.explode(F.array("src", "dst")).alias("id")).where("id % 2 = 0").distinct())


@query("simple_paths", f"WITH RECURSIVE {_EDGE}, w(path, at_, n) AS (SELECT [1::BIGINT], 1::BIGINT, 0 UNION ALL SELECT list_append(path, dst), dst, n + 1 FROM w JOIN e ON src = at_ WHERE NOT list_contains(path, dst) AND n < 4 AND at_ <> 9) SELECT array_to_string(path, '>') path, CAST(n AS BIGINT) n_edges FROM w WHERE at_ = 9")
def simple_paths(spark, sf):
    one = lambda i: spark.createDataFrame([(i,)], "id long")
    return G.simple_paths(_edges(spark, sf), one(1), one(9), 4).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "n_edges")


@query("closure", f"WITH RECURSIVE {_EDGE}, w AS (SELECT 2::BIGINT id UNION SELECT dst FROM w JOIN e ON src = id) SELECT id FROM w")
def closure(spark, sf):
    return G.closure(_edges(spark, sf), spark.createDataFrame([(2,)], "id long"))


@query("deg_presence", "SELECT w, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'once' ELSE 'multiple' END presence FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) w FROM part) LEFT JOIN (SELECT split_part(p_name, ' ', 1) w, count(*) n FROM part WHERE p_size < 3 GROUP BY 1) USING (w)")
def deg_presence(spark, sf):
    p = table(spark, sf, "part")
    nodes = p.where("p_size < 3").select(F.substring_index("p_name", " ", 1).alias("label"))
    return G.presence(nodes, p.select(F.explode(F.split("p_name", " ")).alias("symbol")).distinct()).select(F.col("symbol").alias("w"), "presence")


@query("node_search", "SELECT n_nationkey, n_name FROM nation WHERE upper(trim(n_name)) = 'NATION_1' OR (NOT EXISTS (SELECT 1 FROM nation WHERE upper(trim(n_name)) = 'NATION_1') AND starts_with(upper(trim(n_name)), 'NATION_1'))")
def node_search(spark, sf):
    return G.matched(table(spark, sf, "nation"), "nation_1 ", "n_name").select("n_nationkey", "n_name")
