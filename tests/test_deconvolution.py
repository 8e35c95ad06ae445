"""What follows from fractions, on a mixture that is known."""

import math

import numpy as np

from larkspan.operators import deconvolution as D
from larkspan.operators import ml


def test_counts_purity_and_baseline(spark):
    rng = np.random.default_rng(8)
    genes, states = [f"g{i}" for i in range(30)], ["mal", "imm", "fib"]
    level = rng.gamma(0.6, 10, (3, 30)).round(2)
    phi = (level + 1e-9) / (level + 1e-9).sum(1, keepdims=True)
    theta = rng.dirichlet(np.ones(3), 5)
    counts = 1e6 * theta @ phi
    bulk = spark.createDataFrame([(f"s{i}", g, float(counts[i, j])) for i in range(5) for j, g in enumerate(genes)] + [("s0", "none", 5.0)], "sample string, gene string, count double").repartition(3)
    ref = spark.createDataFrame([(s, g, float(level[k, j])) for k, s in enumerate(states) for j, g in enumerate(genes) if level[k, j]], "state string, gene string, level double")
    p = D.profiles(ref)
    assert all(math.isclose(r.phi, phi[states.index(r.state), genes.index(r.gene)], rel_tol=1e-9) for r in p.collect()) and p.count() == 90
    t = spark.createDataFrame([(f"s{i}", s, float(theta[i, k])) for i in range(5) for k, s in enumerate(states)], "sample string, state string, theta double")
    z = D.expected_counts(bulk, t, p)
    got = {(r["sample"], r.state, r.gene): r.z for r in z.collect()}
    assert len(got) == 5 * 3 * 30
    for (s, k, g), v in got.items():
        i, a, j = int(s[1:]), states.index(k), genes.index(g)
        assert math.isclose(v, counts[i, j] * theta[i, a] * phi[a, j] / (theta[i] @ phi[:, j]), rel_tol=1e-9, abs_tol=1e-9)
    cpm = {(r["sample"], r.gene): r.cpm for r in D.state_expression(z, "imm").collect()}
    assert math.isclose(sum(v for (s, _), v in cpm.items() if s == "s2"), 1e6, rel_tol=1e-9)
    share = {r.state: r.share for r in D.compartment_share(z, "g3").collect()}
    assert math.isclose(sum(share.values()), 1.0) and math.isclose(share["fib"], sum(got[f"s{i}", "fib", "g3"] for i in range(5)) / counts[:, 3].sum(), rel_tol=1e-9)
    mal, env = D.updated_reference(z, ["mal"])
    assert all(math.isclose(r.psi, phi[0, genes.index(r.gene)], rel_tol=1e-6) for r in mal.collect())  # counts are exact, so the profile comes back
    assert math.isclose(sum(r.psi for r in env.collect()), 1.0, rel_tol=1e-9)
    two = counts * 0 + 1e6 * (theta[:, :1] * phi[0] + (1 - theta[:, :1]) * phi[1])
    b2 = spark.createDataFrame([(f"s{i}", g, float(two[i, j])) for i in range(5) for j, g in enumerate(genes)], "sample string, gene string, count double")
    pure = D.refitted(b2, mal, p.where("state = 'imm'").selectExpr("gene", "phi psi"))
    assert all(abs(r.purity - theta[int(r["sample"][1:]), 0]) < 1e-4 for r in pure.collect())
    w = {(r["sample"], r.state): r.weight for r in D.nnls_fractions(bulk.where("gene <> 'none'"), p).collect()}
    assert all(abs(w[f"s{i}", s] - theta[i, k]) < 1e-3 for i in range(5) for k, s in enumerate(states))
    assert D.nnls_fractions(bulk.limit(0), p).count() == 0 and ml.nonnegative_weights(np.eye(2), np.array([1.0, -1.0])).tolist() == [1.0, 0.0]
