"""Ranks and false discovery rates against loops, with ties, nulls, NaN, infinities and values of all sizes."""

import math
import random

from pyspark.sql import functions as F

from larkspan.operators import windows as W


def _values(rnd):
    return [rnd.choice([0.0, -0.0, 1.0, 0.5, 0.25, -3.5, 1e-300, -1e-300, 5e-324, 1e300, float("inf"), float("-inf"), 2.0**-40, 0.1 + 0.2, 0.3, rnd.random(), rnd.gauss(0, 1), rnd.random() ** 30]) for _ in range(400)]


def test_buckets_keep_the_order(spark):
    rnd = random.Random(1)
    v = sorted({*_values(rnd), *(math.nextafter(2.0**k, d) for k in range(-60, 60) for d in (0, math.inf)), *(2.0**k for k in range(-60, 60))})
    rows = spark.createDataFrame([(x,) for x in v], "v double").select("v", W._bucket(F.col("v")).alias("b")).collect()
    b = [r.b for r in sorted(rows, key=lambda r: r.v)]
    assert b == sorted(b) and len(set(b)) > len(b) / 3


def test_average_ranks(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "b", None]), v) for v in [*_values(rnd), None, None]]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("id", F.monotonically_increasing_id())
    got = W.average_rank(df, ["k"], "v", "r").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [v for k, v in rows if k == r.k]
        low = lambda v: -math.inf if v is None else v
        less = sum((v is None and r.v is not None) or (v is not None and r.v is not None and v < r.v) for v in own)
        same = sum((v is None) == (r.v is None) and low(v) == low(r.v) for v in own)
        assert r.r == less + (same + 1) / 2
    whole = W.average_rank(spark.createDataFrame([(3,), (1,), (3,), (-7,)], "v int"), [], "v", "r")
    assert sorted((r.v, r.r) for r in whole.collect()) == [(-7, 1.0), (1, 2.0), (3, 3.5), (3, 3.5)]
    assert W.average_rank(df.limit(0), ["k"], "v", "r").count() == 0


def test_rates(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([rnd.random(), rnd.random() ** 25, 0.04, 0.5, 1.0, 0.0, None, float("nan")])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k int, p double")
    for keys in (["k"], []):
        bh, naive = W.fdr_bh(df, keys, "p"), W.fdr_naive(df.where("not isnan(p) or p is null"), keys, "p")
        for r in bh.collect():
            own = sorted(1.0 if p is None or p != p else p for k, p in rows if not keys or k == r.k)
            mine = 1.0 if r.p is None or r.p != r.p else r.p
            n = len(own)
            assert math.isclose(r.fdr, min(1.0, min(q * n / (i + 1) for i, q in enumerate(own) if q >= mine)), rel_tol=1e-12)
        for r in naive.collect():
            own = [1.0 if p is None else p for k, p in rows if (not keys or k == r.k) and not (p is not None and p != p)]
            mine = 1.0 if r.p is None else r.p
            rank = sum(q < mine for q in own) + (sum(q == mine for q in own) + 1) / 2
            assert math.isclose(r.fdr, min(1.0, mine * len(own) / rank), rel_tol=1e-12)
        assert bh.count() == len(rows)


def test_no_window_holds_a_whole_group(spark):
    df = spark.range(10).selectExpr("id % 2 k", "id / 10 p")
    for out in (W.fdr_bh(df, ["k"], "p"), W.fdr_naive(df, ["k"], "p"), W.average_rank(df, ["k"], "p", "r")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.split("\n"):
            if "Window [" in line:
                assert "__b" in line.split("windowspecdefinition", 1)[1] or "sum(__t" in line, line  # over buckets' totals, or within a bucket
