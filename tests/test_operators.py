"""Operators on small hand-made tables, edge cases included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.functions import scalar as S
from larkspan.operators import aggregates, evidence, graph, joins, ml, pathways, stats, windows
from larkspan.sources import tables


def test_distribution_tails_agree_with_known_values():
    assert D.student_two_sided(np.array([2.228138852]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-8)
    assert D.chi2_upper(np.array([3.841458821, 11.07049769]), np.array([1.0, 5.0])) == pytest.approx([0.05, 0.05], abs=1e-8)
    assert D.f_upper(np.array([4.964602744]), np.array([1.0]), np.array([10.0]))[0] == pytest.approx(0.05, abs=1e-8)
    assert D.normal_sf(np.array([1.959963985]))[0] == pytest.approx(0.025, abs=1e-9)
    assert D.student_quantile(0.975, np.array([10.0]))[0] == pytest.approx(2.228138852, abs=1e-6)


def test_normal_cdf_in_columns(spark):
    df = spark.createDataFrame([(z,) for z in (-6.0, -2.0, -0.3, 0.0, 1.0, 3.9, 4.1, 8.0)], "z double")
    for r in df.select("z", evidence.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), abs=1e-12)


def test_overlaps_keep_touching_intervals_apart_and_count_pairs_once(spark):
    a = spark.createDataFrame([(1, "c", 0, 100), (2, "c", 100, 300)], "id int, chrom string, start long, end long")
    b = spark.createDataFrame([(9, "c", 50, 250), (8, "c", 300, 301), (7, "d", 0, 999)], "id int, chrom string, start long, end long")
    got = joins.overlaps(a, b, ["chrom"], width=16).select("id", "id_b").collect()
    assert sorted(map(tuple, got)) == [(1, 9), (2, 9)]


def test_array_containment_is_a_left_join_without_repeats(spark):
    left = spark.createDataFrame([("d1", "t1"), ("d2", "t9"), (None, "t1")], "d string, t string")
    right = spark.createDataFrame([(1, ["d1", "d1"], ["t1", "t1"]), (2, [], ["t1"]), (3, None, None)], "m int, ds array<string>, ts array<string>")
    got = joins.array_containment(left, right, ["d", "t"], ["ds", "ts"], "m").select("d", "m").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(["('d1', 1)", "('d2', None)", "(None, None)"])


def test_one_to_one_raises(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.one_to_one(a, b, ["k"])


def test_fdr_handles_null_nan_and_ties(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.01), (3, None), (4, float("nan")), (5, 0.0)], "i int, p double")
    got = {r.i: r.fdr for r in windows.fdr_bh(df, [], "p").collect()}
    assert got == pytest.approx({5: 0.0, 1: 0.05 / 3, 2: 0.05 / 3, 3: 1.0, 4: 1.0})


def test_entropy_of_one_item_is_zero(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "g string, w int")
    got = {r.g: r.norm_entropy for r in aggregates.entropy(df, ["g"], "w").collect()}
    assert got == pytest.approx({"a": 0.0, "b": 1.0})


def test_pathway_index_with_one_side_only(spark):
    genes = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("r", "z")], "p string, g string")
    lfc = spark.createDataFrame([("a", 2.0), ("b", 5.0), ("c", -1.0), ("z", 0.1)], "g string, v double")
    got = {r.p: r for r in pathways.modulation_index(genes, lfc, "p", "g", "v").collect()}
    assert set(got) == {"p", "q"} and got["p"].up == 5.0 and got["p"].ratio == 15.0 and got["q"].ratio == pytest.approx(1 / 3)


def test_stage_and_labels(spark):
    df = spark.createDataFrame([("Stage IIIC",), ("stage iv",), ("STAGE X",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(S.stage("s")).collect()] == ["III", "IV", "missing", None, None]
    one = spark.range(1).select(S.roman(F.lit(1994)), S.month_number(F.lit("March")), S.rgb_to_hex(F.lit(255), F.lit(0), F.lit(16)), S.is_date(F.lit("2024-02-30")), S.is_curie(F.lit("MONDO:0005148"))).first()
    assert tuple(one) == ("MCMXCIV", 3, "#ff0010", False, True)


def test_simple_paths_stop_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")], "src string, dst string")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    assert sorted(r.path for r in graph.simple_paths(e, one("a"), one("c")).collect()) == [["a", "b", "c"], ["a", "c"]]
    assert sorted(r.id for r in graph.closure(e, one("b")).collect()) == ["a", "b", "c"]


def _hypothesis(spark, state="under_test", claim="causal"):
    return spark.createDataFrame([("h", state, claim, 0.0, True)], "hid string, state string, claim string, prior_log_odds double, registered boolean")


ITEMS = "hid string, kind string, independence_class string, raw_lr double, reliability double, field_penalty double, decisive boolean, confirmatory boolean"
PRED = "hid string, critical boolean, operator string, threshold double, observed double"
TRY = "hid string, actor string, independent_of string, succeeded boolean"


@pytest.mark.parametrize(
    ("items", "observed", "tries", "state"),
    [
        ([("literature", 50.0)] * 3, None, 2, "under_test"),  # texts alone
        ([("own_omics", 50.0), ("public_omics", 50.0)], None, 2, "under_test"),  # no intervention
        ([("wetlab", 50.0), ("perturbation", 50.0)], None, 2, "surviving"),
        ([("wetlab", 50.0), ("perturbation", 50.0)], None, 1, "under_test"),  # one attempt only
        ([("wetlab", 50.0), ("perturbation", 50.0)], 0.2, 2, "refuted"),  # a critical prediction failed
        ([("wetlab", 0.001), ("perturbation", 0.001)], None, 2, "refuted"),
    ],
)
def test_adjudication(spark, items, observed, tries, state):
    i = spark.createDataFrame([("h", k, f"c{n}", lr, None, 1.0, False, False) for n, (k, lr) in enumerate(items)], ITEMS)
    p = spark.createDataFrame([("h", True, ">=", 1.0, observed)], PRED)
    a = spark.createDataFrame([("h", f"c{n}", "g", False) for n in range(tries)] + [("h", "g", "g", False)], TRY)
    assert evidence.adjudicated(_hypothesis(spark), i, p, a).first().state == state


def test_redundant_items_count_less(spark):
    rows = [("h", "literature", "same", 10.0, None, 1.0, False, False)] * 5
    one = evidence.aggregate_log_lr(spark.createDataFrame(rows[:1], ITEMS)).first().log_lr
    assert one < evidence.aggregate_log_lr(spark.createDataFrame(rows, ITEMS)).first().log_lr < 1.3 * one


def test_a_changed_ledger_row_is_found(spark):
    e = spark.createDataFrame([("c", i, f"p{i}") for i in range(5)], "chain string, seq int, payload string")
    sealed = evidence.sealed(e, ["seq"])
    assert evidence.ledger_faults(sealed, ["seq"]).count() == 0
    bad = sealed.withColumn("payload", F.when(F.col("seq") == 3, "x").otherwise(F.col("payload")))
    assert [(r.seq, r.fault) for r in evidence.ledger_faults(bad, ["seq"]).collect()] == [(3, "payload")]


def test_useless_assays_are_not_planned(spark):
    h = spark.createDataFrame([("h", "under_test", "causal", 0.5, False, False)], "hid string, state string, claim string, posterior double, primary boolean, intervened boolean")
    kinds = "aid string, kind string, sensitivity double, specificity double, cost double, applicable_to array<string>, identifies_causal boolean, feasible boolean"
    assays = spark.createDataFrame([("good", "wetlab", 0.8, 0.85, 100.0, [], True, True), ("coin", "wetlab", 0.5, 0.5, 1.0, [], True, True)], kinds)
    assert [r["aid"] for r in evidence.plan(evidence.candidates(h, assays), 1000.0)] == ["good"]
    assert evidence.unidentifiable(h, assays).count() == 0
    assert evidence.unidentifiable(h, assays.where("aid = 'coin'")).first().missing == "an intervention; primary data"


def test_em_and_least_squares_recover_a_mixture(spark):
    rng = np.random.default_rng(0)
    ref = {s: {f"g{i}": float(v) for i, v in enumerate(rng.random(30) + 0.05)} for s in ("a", "b", "c")}
    phi = {s: {g: v / sum(p.values()) for g, v in p.items()} for s, p in ref.items()}
    true = {"a": 0.6, "b": 0.3, "c": 0.1}
    rows = [("x", f"g{i}", 1e6 * sum(true[s] * phi[s][f"g{i}"] for s in ref)) for i in range(30)]
    got = {r.state: r.theta for r in ml.em_fractions(spark.createDataFrame(rows, "s string, g string, c double"), ref, "s", "g", "c").collect()}
    assert got == pytest.approx(true, abs=0.01)
    w = ml.nonnegative_weights(np.array([[phi[s][f"g{i}"] for s in ref] for i in range(30)]), np.array([r[2] for r in rows]) / 1e6)
    assert w == pytest.approx(list(true.values()), abs=1e-3)


def test_factorial_terms_agree_with_least_squares(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 60), rng.integers(0, 2, 60)
    y = 1 + 2 * a - b + 0.5 * a * b + rng.normal(size=60)
    df = spark.createDataFrame([("g", float(v), int(i), int(j)) for v, i, j in zip(y, a, b)], "g string, y double, a int, b int")
    got = {r.term: (r.estimate, r.t) for r in stats.factorial_ols(df, ["g"], "y", "a", "b").collect()}
    x = np.stack([np.ones(60), a, b, a * b], 1)
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * rss[0] / 56)
    for i, t in enumerate(("a", "b", "ab"), 1):
        assert got[t] == pytest.approx((beta[i], beta[i] / se[i]))


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("a", 2)], "k string, v int")
    tables.write_delimited(df, str(tmp_path / "t"))
    back = tables.read_delimited(spark, str(tmp_path / "t"), "k string, v int", names=["x", "y"], order=["x"], distinct=True)
    assert sorted(map(tuple, back.collect())) == [("a", 2), ("b", 1)]
    (tmp_path / "g.gff").write_text("#c\n1\ts\tgene\t5\t9\t.\t+\t.\tID=g1;Name=n 1\n1\ts\tmRNA\t5\t9\t.\t+\t.\tID=m1\n")
    assert [(r.feature, r.ID, r.Name) for r in tables.read_gff(spark, str(tmp_path / "g.gff"), ["ID", "Name"]).collect()] == [("gene", "g1", "n 1"), ("mRNA", "m1", None)]
    calls = []
    build = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.materialised(spark, str(tmp_path / "m"), build).count() == 3
    assert len(calls) == 1 and tables.view(spark, "nothing", str(tmp_path / "none")) is False
    nested = spark.createDataFrame([((1, ("x",)),)], "a struct<b:int,c:struct<d:string>>")
    assert tables.flattened(nested).columns == ["a.b", "a.c.d"]
    assert tables.without_ids(spark.createDataFrame([(1, 2)], "id int, `G (12)` int")).columns == ["id", "G"]


def test_markdown_refuses_what_it_would_cut(spark):
    df = spark.range(3).selectExpr("id", "id / 3 AS x")
    assert tables.markdown(df.orderBy("id"), most=3).split("\n")[2:] == ["| 0 | 0.000 |", "| 1 | 0.333 |", "| 2 | 0.667 |"]
    with pytest.raises(ValueError, match="more than 2 rows"):
        tables.markdown(df, most=2)
    assert tables.markdown(df.limit(0)) == "| id | x |\n|---|---|"


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    from larkspan.streaming.windows import hourly_counts, stream_counts

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream_counts(spark, str(tmp_path / "in"), events.schema, str(tmp_path / "out"), str(tmp_path / "cp"), "0 seconds")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= {tuple(r) for r in hourly_counts(events).collect()}


def test_consensus_takes_every_vector(spark, tmp_path):
    import numpy as np

    from larkspan.plans.registry import QUERIES

    rnd = np.random.default_rng(4)
    x = {i: [float(v) for v in rnd.normal(3 * (i % 2) if i < 60 else 0, 1, 3)] for i in range(80)}
    df = spark.createDataFrame(list(x.items()), "vec_id long, embedding array<double>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    chosen = df.selectExpr("vec_id", "explode(sequence(1, 20)) rep").where("pmod(xxhash64(1, rep, vec_id), 1000) < 800").collect()
    same, both = {}, {}
    for rep in range(1, 21):
        groups = [[i] for i in sorted(r.vec_id for r in chosen if r.rep == rep)]
        far = lambda g, h: sum(np.linalg.norm(np.subtract(x[a], x[b])) for a in g for b in h) / (len(g) * len(h))
        d = {(p, q): far(groups[p], groups[q]) for q in range(len(groups)) for p in range(q)}
        alive = set(range(len(groups)))
        while len(alive) > 3:
            p, q = min(d, key=d.get)
            groups[p] = groups[p] + groups[q]
            alive.remove(q)
            d = {k: v for k, v in d.items() if not {p, q} & set(k)} | {(min(p, r), max(p, r)): far(groups[p], groups[r]) for r in alive if r != p}
        of = {i: g for g in alive for i in groups[g]}
        for a in of:
            for b in of:
                if a < b:
                    both[a, b] = both.get((a, b), 0) + 1
                    same[a, b] = same.get((a, b), 0) + (of[a] == of[b])
    expected = np.mean([0.1 < same[k] / n < 0.9 for k, n in both.items()])
    assert abs(QUERIES["consensus_pac"](spark, str(tmp_path)).first().pac - expected) < 1e-9


def _shuffled_means(spark, tmp_path, name, values, group):
    """A query on line items whose values come in several orders."""
    from larkspan.plans import registry

    spark.createDataFrame([(1, "A")], "p_partkey long, p_type string").union(spark.createDataFrame([(2, "Z")], "p_partkey long, p_type string")).write.parquet(str(tmp_path / "part.parquet"))
    rows = [(*group(k, i), v) for k in range(12) for i, v in enumerate(values[k % len(values):] + values[: k % len(values)])]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string, l_discount double").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return registry.QUERIES[name](spark, str(tmp_path)).collect()


def test_means_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    values = [0.01, 0.02, 0.03, 0.1, 0.07, 0.06, 0.04, 0.09, 0.03, 0.05, 0.06, 0.04]  # of mean 0.05
    calls = _shuffled_means(spark, tmp_path / "s", "signature_calls", [x for pair in zip(values, values[::-1]) for x in pair], lambda k, i: (k, 1 + i % 2, "A"))
    assert {(r.delta, r.call) for r in calls if r.l_suppkey % 2 == 0} == {(0.0, "classical")}


@pytest.mark.parametrize("name", ["enrichment_score", "wtcs_ncs", "two_conditions"])
def test_equal_means_are_told_apart_as_in_sql(spark, tmp_path, name):
    """Five means, each equal up to its last bit, over several files: SQL in one thread adds the rows file by file."""
    import duckdb

    from larkspan.plans import registry

    rng = np.random.default_rng(5)
    values = [0.01, 0.02, 0.03, 0.1, 0.07, 0.06, 0.04, 0.09, 0.03, 0.05, 0.06, 0.04]
    rows = [(s, 52 * s + p, f, round(v + 0.01 * (p * s % 5 - 2), 2)) for s in range(30) for p in range(52) for f in "AR" for v in rng.permutation(values).tolist()]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    spark.createDataFrame([(p, chr(65 + p % 26) + str(p % 52)) for p in range(52 * 30)], "p_partkey long, p_type string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_returnflag string, l_discount double").repartition(7).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = registry.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect(config={"threads": 1})
    for t in ("part", "lineitem"):
        duck.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = duck.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]}) order by 1").fetchall()
    assert sorted(tuple(r) for r in df.collect()) == want


def test_equal_means_are_ranked_by_name(spark):
    from larkspan.operators import aggregates

    rows = [(g, v) for g, vs in {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [0.2], "d": [0.05] * 7, "e": [0.01, 0.09], "f": [float("nan"), 1.0], "g": [None]}.items() for v in vs]
    got = {r.g: r.m for r in spark.createDataFrame(rows, "g string, v double").coalesce(1).groupBy("g").agg(aggregates.exact_mean("v").alias("m")).collect()}
    assert got["a"] == got["b"] == got["c"] == 0.2 and got["d"] == got["e"] == 0.05 and got["f"] != got["f"] and got["g"] is None


def test_theta_join_has_no_join_of_all_pairs(spark, tmp_path):
    from larkspan.plans import registry

    spark.range(300).selectExpr("id s_suppkey", "cast(id % 3 as int) s_nationkey").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.range(7500).selectExpr("id p_partkey", "cast(id % 7 as int) p_size").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(40).selectExpr("id l_suppkey", "id l_partkey", "1 l_linenumber", "id l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = registry.QUERIES["array_theta_join"](spark, str(tmp_path))
    assert sorted((r.l_suppkey, r.moa) for r in df.collect()) == [(i, i % 3) for i in range(40)]

    def rows_of(p):
        kids = [p.executedPlan()] if p.nodeName() == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in p.nodeName() else [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().get("numOutputRows").get().value() if "Join" in p.nodeName() and p.metrics().contains("numOutputRows") else 0
        return max([own, *map(rows_of, kids)])

    assert 0 < rows_of(df._jdf.queryExecution().executedPlan()) < 30_000  # 300 suppliers by 300 parts of each nation would be 90,000


def test_mixture_reads_parts_once_and_broadcasts_none(spark):
    from larkspan.plans import models

    for df in models._mixture(spark, "/root/testdata/sf0.001"):
        assert "part.parquet" not in " ".join(df.inputFiles())
