"""Sources and sinks on derived files, and the small operators between them, each with the SQL that states the same rows."""

from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.operators import evidence, filters, graph, joins
from larkspan.operators.lineage import Steps
from larkspan.plans.registry import query, table
from larkspan.sources import atlas, tables


def _sharded(spark, sf, at):
    """Line items with a file for every five quantities."""
    lines = table(spark, sf, "lineitem").withColumn("shard", F.floor((F.col("l_quantity") - 1) / 5).cast("int"))
    lines.repartition("shard").write.partitionBy("shard").parquet(at)


@query("delimited_roundtrip", "SELECT DISTINCT c_mktsegment segment, c_nationkey nation FROM customer")
def delimited_roundtrip(spark, sf):
    at = Steps(spark).path
    tables.write_delimited(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), at)
    return tables.read_delimited(spark, at, "c_custkey long, c_mktsegment string, c_nationkey int", names=["key", "segment", "nation"], columns=["segment", "nation"], order=["nation"], distinct=True)


@query("parquet_views", "SELECT o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY 1")
def parquet_views(spark, sf):
    at = Steps(spark).path
    for i, s in enumerate("FOP"):
        table(spark, sf, "orders").where(F.col("o_orderstatus") == s).write.parquet(f"{at}/orders_by_status/{i}")
    if tables.views(spark, at, ["orders_by_status", "no_such_table"]) != ["orders_by_status"]:
        raise RuntimeError("views")
    return spark.sql("SELECT o_orderstatus, count(*) n, round(sum(o_totalprice), 2) total FROM orders_by_status GROUP BY 1")


@query("schema_names", "SELECT column_name \"column\" FROM (DESCRIBE SELECT * FROM customer)")
def schema_names(spark, sf):
    return tables.schema_summary(table(spark, sf, "customer")).select("column")


@query("footer_ranges", "SELECT min(l_quantity) lo, max(l_quantity) hi, count(*) n_rows FROM lineitem GROUP BY CAST(l_quantity - 1 AS BIGINT) // 5")
def footer_ranges(spark, sf):
    at = Steps(spark).path
    _sharded(spark, sf, f"{at}/shards")
    return atlas.footer_index(spark, f"{at}/shards", "l_quantity", f"{at}/index").select(F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), "n_rows")


@query("shard_blocks", "SELECT min(l_quantity) lo, 1::BIGINT n_shards FROM lineitem GROUP BY CAST(l_quantity - 1 AS BIGINT) // 5")
def shard_blocks(spark, sf):
    at = Steps(spark).path
    _sharded(spark, sf, at)
    return tables.index_coverage(tables.shard_index(spark, [at], "l_quantity")).select("lo", "n_shards")


@query("resumed_scan", "WITH s AS (SELECT DISTINCT CAST(l_quantity - 1 AS BIGINT) // 5 s FROM lineitem) SELECT CASE WHEN s < 2 THEN 'before' ELSE 'done' END state, count(*) n, (SELECT count(*) FROM lineitem WHERE l_discount > 0.05) n_rows FROM s GROUP BY 1")
def resumed_scan(spark, sf):
    """A scan of two shards, then one of all, which goes on with the rest."""
    at = Steps(spark).path
    _sharded(spark, sf, f"{at}/shards")
    names = sorted(r.shard for r in atlas.shard_files(spark, f"{at}/shards").collect())
    rows = lambda df: df.where("l_discount > 0.05")
    atlas.scan(spark, [n for n in names if "shard=0/" in n or "shard=1/" in n], f"{at}/out", rows, batch=1)
    told = atlas.scan(spark, names, f"{at}/out", rows, batch=1)
    n = atlas.scanned(spark, f"{at}/out").agg(F.count("*").alias("n_rows"))
    return told.groupBy("state").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n))  # one row


@query("memoised_table", "SELECT p_brand, count(*) FILTER (p_size <= 10) small, count(*) FILTER (p_size > 10) large FROM part GROUP BY 1")
def memoised_table(spark, sf):
    at = f"{Steps(spark).path}/table"

    def build():
        p = table(spark, sf, "part")
        return tables.without_ids(p.groupBy("p_brand").agg(F.count_if(F.col("p_size") <= 10).alias("small (17)"), F.count_if(F.col("p_size") > 10).alias("large (4)")))

    def again():
        raise RuntimeError("built twice")

    tables.materialised(spark, at, build)
    return tables.materialised(spark, at, again)


@query("attached_metadata", "SELECT l_suppkey, count(*) n, any_value(s_name) s_name FROM lineitem LEFT JOIN (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey GROUP BY 1")
def attached_metadata(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return tables.attach(counts, table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")


@query("json_flattened", "SELECT conv_id \"id\", turn \"meta.turn\", role \"meta.by.role\", length(text) n_chars FROM conversations")
def json_flattened(spark, sf):
    at = Steps(spark).path
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.struct("turn", F.struct("role").alias("by")).alias("meta"), F.length("text").cast("long").alias("n_chars"))
    tables.write_text(c, at, F.to_json(F.struct("id", "meta", "n_chars")))
    return tables.flattened(tables.json_lines(spark, at, "id long, meta struct<turn:long,by:struct<role:string>>, n_chars long"))


@query("gff_features", "SELECT p_brand seqname, p_type feature, 'P' || p_partkey ID, p_name Name, CAST(p_partkey * 100 AS BIGINT) start, CAST(p_partkey * 100 + p_size AS BIGINT) \"end\" FROM part")
def gff_features(spark, sf):
    at = Steps(spark).path
    p = table(spark, sf, "part")
    start = F.col("p_partkey") * 100
    tables.write_text(p, at, F.concat_ws("\t", "p_brand", F.lit("made"), "p_type", start, start + F.col("p_size"), F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=P"), "p_partkey", F.lit(";Name="), "p_name", F.lit(";Note=x"))))
    return tables.read_gff(spark, at, ["ID", "Name"]).select("seqname", "feature", "ID", "Name", "start", "end")


@query("matrix_market", "WITH c AS (SELECT p_brand b, p_type t, count(*) n FROM part GROUP BY 1, 2), x AS (SELECT b, dense_rank() OVER (ORDER BY b) i, t, dense_rank() OVER (ORDER BY t) j, n FROM c) SELECT i || ' ' || j || ' ' || n entry FROM x")
def matrix_market(spark, sf):
    at = Steps(spark).path
    tables.export_for_matrix_market(table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n")), "p_brand", "p_type", "n", at)
    return spark.read.text(f"{at}/entries").withColumnRenamed("value", "entry")


@query("markdown_table", "SELECT '| r_name | nations |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' |', chr(10) ORDER BY r_name) \"text\" FROM (SELECT r_name, count(*) n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1)")
def markdown_table(spark, sf):
    r = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("nations"))
    return spark.createDataFrame([(tables.markdown(r.orderBy("r_name")),)], "text string")


@query("display_lists", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ', ') nations FROM nation GROUP BY 1")
def display_lists(spark, sf):
    return tables.display_safe(table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations")))


@query("significant_pathways", "SELECT p_brand, pval, fdr, num_of_genes FROM (SELECT p_brand, round(avg(l_discount), 6) pval, round(avg(l_tax), 6) fdr, count(DISTINCT p_partkey) num_of_genes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) WHERE pval < 0.0501 AND fdr < 0.0405 AND num_of_genes >= 3")
def significant_pathways(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    p = lines.groupBy("p_brand").agg(F.round(F.avg("l_discount"), 6).alias("pval"), F.round(F.avg("l_tax"), 6).alias("fdr"), F.count_distinct("p_partkey").alias("num_of_genes"))
    return filters.significant_pathways(p, 0.0501, 0.0405, 3)


@query("directed_changes", "SELECT p_partkey, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' END direction FROM (SELECT p_partkey, p_size - 25 d FROM part) WHERE p_partkey % 2 = 0")
def directed_changes(spark, sf):
    return filters.up_down(table(spark, sf, "part").where("p_partkey % 2 = 0").withColumn("lfc", F.col("p_size") - 25)).select("p_partkey", "direction")


@query("case_validity", "SELECT valid, count(*) n FROM (SELECT CASE WHEN lower(trim(coalesce(nullif(event_type, 'error'), ''))) IN ('', 'unknown', 'not reported') THEN 'invalid' WHEN user_id % 3 = 0 THEN 'ambiguous' ELSE 'valid' END valid FROM events) GROUP BY 1")
def case_validity(spark, sf):
    e = table(spark, sf, "events").select(F.nullif("event_type", F.lit("error")).alias("diagnosis"), F.when(F.col("user_id") % 3 == 0, "other").otherwise("adeno").alias("subtype"))
    return e.groupBy(S.validity("diagnosis", "subtype").alias("valid")).agg(F.count("*").alias("n"))


@query("one_to_one", "SELECT c_nationkey k, n_name, count(*) n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2")
def one_to_one(spark, sf):
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return joins.one_to_one(counts, table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name"), ["k"])


@query("top_in_cluster", "SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) i FROM customer) WHERE i <= 3")
def top_in_cluster(spark, sf):
    return filters.top_per_group(table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3)


@query("summed_duplicates", "SELECT p_name, p_type, sum(p_size) total FROM part GROUP BY 1, 2")
def summed_duplicates(spark, sf):
    return table(spark, sf, "part").groupBy("p_name", "p_type").agg(F.sum("p_size").alias("total"))


@query("nodes_opened", "WITH e AS (SELECT DISTINCT n_nationkey::BIGINT a, (n_nationkey * 7 + 3) % 25 b FROM nation) SELECT 4::BIGINT id UNION SELECT b FROM e WHERE a = 4 UNION SELECT a FROM e WHERE b = 4")
def nodes_opened(spark, sf):
    edges = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).cast("long").alias("dst"))
    node = edges.where("src = 4").select(F.col("src").alias("id"))
    return graph.toggled(node, edges, node)


@query("unidentifiable", "SELECT c_nationkey hid, 'an intervention; primary data' missing FROM customer GROUP BY 1 HAVING count(*) % 2 = 1")
def unidentifiable(spark, sf):
    """Nations of an odd number of customers: hypotheses that are settled, so that no assay informs them; of the others one does."""
    n = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("hid")).agg(F.count("*").alias("n"))
    h = n.select("hid", F.when(F.col("n") % 2 == 1, 1e-9).otherwise(0.5).alias("posterior"), F.lit("causal").alias("claim"), F.lit(False).alias("intervened"), F.lit(False).alias("primary"))
    assays = spark.createDataFrame([("a1", 0.9, 0.9, True), ("a2", 0.99, 0.99, False)], "aid string, sensitivity double, specificity double, feasible boolean")
    return evidence.unidentifiable(h, assays)


@query("resolved_names", "SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def resolved_names(spark, sf):
    vocabulary = table(spark, sf, "region").select(F.col("r_regionkey").alias("key"), "r_name")
    return evidence.resolved(table(spark, sf, "nation").select("n_name", F.col("n_regionkey").alias("key")), vocabulary, "key").select("n_name", "r_name")
