"""Statistical tests against published values and exact enumeration."""

import math
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from larkspan.functions import distributions as D
from larkspan.operators import cohorts, pathways, stats


def test_fisher_by_enumeration(spark):
    tables = [(3, 1, 1, 3), (8, 2, 1, 5), (0, 5, 5, 0), (0, 0, 3, 4), (10, 0, 0, 10), (1, 9, 11, 3)]

    def brute(a, b, c, d):
        n, row, col = a + b + c + d, a + b, a + c
        p = {i: math.comb(row, i) * math.comb(n - row, col - i) for i in range(max(0, col - (n - row)), min(row, col) + 1)}
        return sum(v for v in p.values() if v <= p[a]) / sum(p.values())

    got = D.fisher_two_sided(*np.array(tables, float).T)
    assert np.allclose(got, [brute(*t) for t in tables], rtol=1e-9)
    assert math.isclose(got[0], 0.4857142857, rel_tol=1e-9) and math.isclose(got[5], 0.002759456, rel_tol=1e-5)  # tea tasting; the dieting example
    rows = [(k, i, j) for k, t in enumerate(tables) for (i, j), n in zip(product((True, False), repeat=2), t, strict=True) for _ in range(n)] + [(0, None, True)]
    for r in stats.fisher_exact(spark.createDataFrame(rows, "k int, x boolean, y boolean"), ["k"], F.col("x"), F.col("y")).collect():
        assert (r.a, r.b, r.c, r.d) == tables[r.k] and math.isclose(r.pval, got[r.k], rel_tol=1e-12)


def test_shapiro_published(spark):
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]  # weights of eleven men, of Shapiro and Wilk's paper
    w, p = D.shapiro_wilk(np.array(men, float))
    assert abs(w - 0.7888) < 1e-4 and abs(p - 0.006704) < 1e-4
    rows = [("men", float(v)) for v in men] + [("two", 1.0), ("two", 2.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("three", 1.0), ("three", 2.0), ("three", 3.0), ("men", None), ("men", float("nan"))] + [("many", float(i)) for i in range(30)]
    got = {r.k: r for r in stats.shapiro(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", most=29).collect()}
    assert math.isclose(got["men"].w, w, rel_tol=1e-12) and got["men"].n == 11 and math.isclose(got["three"].w, 1.0, rel_tol=1e-9) and math.isclose(got["three"].pval, 1.0, rel_tol=1e-6)
    assert got["two"].w is None and got["flat"].pval is None and got["many"].w is None and got["many"].n == 30
    rng = np.random.default_rng(1)
    small = [D.shapiro_wilk(np.sort(rng.normal(size=n)))[1] < 0.05 for n in (4, 5, 8, 11, 12, 40, 200) for _ in range(120)]
    assert 0.03 < np.mean(small) < 0.075  # its level


def test_dunnett_published(spark):
    control, a, b = [7.40, 8.50, 7.20, 8.24, 9.84, 8.32], [9.76, 8.80, 7.68, 9.36], [12.80, 9.68, 12.16, 9.20, 10.55]  # blood counts of Dunnett's paper
    rows = [("x", g, v) for g, vs in (("control", control), ("drug_a", a), ("drug_b", b)) for v in vs] + [("x", "drug_a", None), ("y", "drug_a", 1.0), ("z", "control", 1.0), ("z", "drug_a", 2.0)]
    got = {(r.k, r.g): r for r in stats.dunnett(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v", "control").collect()}
    assert set(got) == {("x", "drug_a"), ("x", "drug_b")}
    assert abs(got["x", "drug_a"].pval - 0.6200) < 2e-4 and abs(got["x", "drug_b"].pval - 0.0059) < 1e-4
    for k, df, t in ((1, 10, 2.228), (2, 10, 2.57), (3, 20, 2.54), (5, 20, 2.73)):  # tabled 5 % points of equal groups, to two places
        assert abs(D.dunnett_two_sided(t, np.full(k, 0.5), df) - 0.05) < 6e-4


def test_hypergeometric_tails(spark):
    cases = [(k, n, m, d) for n, m, d in ((40, 10, 12), (2000, 300, 50), (17, 17, 3), (100, 0, 5)) for k in (0, 1, 3, 9)]
    got = spark.createDataFrame(cases, "k long, n long, m long, d long").withColumn("p", pathways.hypergeometric_upper(F.col("k"), F.col("n"), F.col("m"), F.col("d"))).collect()
    for r in got:
        want = sum(math.comb(r.m, i) * math.comb(r.n - r.m, r.d - i) for i in range(r.k, min(r.m, r.d) + 1) if r.d - i <= r.n - r.m) / math.comb(r.n, r.d)
        assert math.isclose(r.p, want, rel_tol=1e-9, abs_tol=1e-300)


def test_random_draws_are_the_least_hashes(spark):
    u = spark.range(3000).withColumnRenamed("id", "gene")
    sets = u.select((F.col("gene") % 7).alias("s"), "gene")
    got = {(r.sim, r.s): r.overlap for r in cohorts.random_set_overlaps(u, "gene", sets, "s", 80, 4).collect()}
    h = spark.range(1, 5).withColumnRenamed("id", "sim").crossJoin(u).select("sim", "gene", F.xxhash64(F.lit(7), "sim", "gene").alias("h")).collect()
    want = {}
    for sim in range(1, 5):
        for r in sorted((r for r in h if r.sim == sim), key=lambda r: (r.h, r.gene))[:80]:
            want[sim, r.gene % 7] = want.get((sim, r.gene % 7), 0) + 1
    assert got == want
    plan = cohorts.random_set_overlaps(u, "gene", sets, "s", 80, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") <= 1  # beside the one row with the number of genes
