"""Consensus clustering, held-out signatures and factorisation against plain numpy."""

import math

import numpy as np
import pytest

from larkspan.operators import consensus as C


def _naive_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        far = lambda g, h: d[np.ix_(g, h)].mean()
        best = min(((far(groups[p], groups[q]), p, q) for p in range(len(groups)) for q in range(p + 1, len(groups))))
        groups[best[1]] = groups[best[1]] + groups[best[2]]
        del groups[best[2]]
    label = np.zeros(len(d), int)
    for n, g in enumerate(sorted(groups, key=min)):
        label[g] = n
    return label


def test_linkage():
    x = np.random.default_rng(1).normal(size=(40, 3))
    d = C.distances(x)
    cuts = C.linkage_labels(d, [2, 5, 17, 40, 60])
    for k in (2, 5, 17):
        assert cuts[k].tolist() == _naive_linkage(d, k).tolist()
    assert cuts[40].tolist() == cuts[60].tolist() == list(range(40))
    with pytest.raises(ValueError):
        C.linkage_labels(np.zeros((C.LANDMARKS + 1, C.LANDMARKS + 1)), [2])


def test_consensus_and_the_chosen_k(spark):
    rng = np.random.default_rng(5)
    n = 200
    x = np.concatenate([rng.normal(c, 0.5, (n // 4, 4)) for c in ((0, 0, 0, 0), (6, 0, 0, 0), (0, 6, 0, 0), (6.5, 0.8, 0, 0))])
    df = spark.createDataFrame([(f"u{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0] * 4), ("none", None)], "unit string, v array<double>").repartition(4)
    picks = df.selectExpr("unit", "explode(sequence(1, 12)) rep").where("unit like 'u%' and pmod(xxhash64(1, rep, unit), 1000) < 800").collect()
    ks = [2, 3, 4, 5]
    want = {}
    own = {rep: sorted(int(r.unit[1:]) for r in picks if r.rep == rep) for rep in range(1, 13)}
    for k in ks:
        both, same = np.zeros((n, n)), np.zeros((n, n))
        for p in own.values():
            c = C.linkage_labels(C.distances(x[p]), [k])[k]
            both[np.ix_(p, p)] += 1
            same[np.ix_(p, p)] += c[:, None] == c[None]
        up = np.triu_indices(n, 1)
        v = same[up][both[up] > 0] / both[up][both[up] > 0]
        want[k] = ((v > 0.1) & (v < 0.9)).mean(), [(v <= t / 100 + 1e-12).mean() for t in range(101)]
    got = {r.k: r for r in C.consensus(df, "unit", "v", ks, 12, min_fraction=0.1).collect()}
    assert sorted(got) == ks
    for k in ks:
        assert math.isclose(got[k].pac, want[k][0], abs_tol=1e-12) and np.allclose(got[k].cdf, want[k][1]) and got[k].ids == [f"u{i:03d}" for i in range(n)]
    fit = {k: got[k].pac for k in ks if got[k].smallest >= 0.1}
    assert [k for k in ks if got[k].chosen] == [min(k for k, p in fit.items() if p <= min(fit.values()) + 0.02)]
    labels = {r.unit: r.cluster for r in C.consensus_labels(df, "unit", "v", [3], repeats=12, most=60).collect()}  # 140 units aren't landmarks
    assert len(labels) == n
    assert len({(labels[f"u{i:03d}"], min(i // 50, 3) if i // 50 != 3 else 1) for i in range(n)}) == 3
    assert C.consensus(df.limit(0), "unit", "v", [2]).count() == 0
    with pytest.raises(ValueError):
        C.consensus(df, "unit", "v", [2], most=C.LANDMARKS + 1)


def _heldout_brute(x, ids, side_a, k, label):
    out = []
    for rep, a in side_a.items():
        b = [i for i in range(len(x)) if i not in a]
        c = C.linkage_labels(C.distances(x[a]), [k])[k]
        centre = np.stack([x[a][c == v].mean(0) for v in range(k)])
        names = []
        for v in range(k):
            own = [label[a[i]] for i in np.flatnonzero(c == v)]
            names.append(min(set(own), key=lambda s: (-own.count(s), s)))
        corr = lambda u, w: ((u - u.mean()) * (w - w.mean())).sum() / (np.linalg.norm(u - u.mean()) * np.linalg.norm(w - w.mean()) + 1e-12)
        got = [names[int(np.argmax([corr(x[i], m) for m in centre]))] for i in b]
        for name in set(got):
            one, two = x[[i for i, g in zip(b, got, strict=True) if g == name]], x[[i for i, g in zip(b, got, strict=True) if g != name]]
            if len(one) < 2 or len(two) < 2:
                continue
            for f in range(x.shape[1]):
                e1, e2 = one[:, f].var(ddof=1) / len(one), two[:, f].var(ddof=1) / len(two)
                out.append((rep, name, f, one[:, f].mean() - two[:, f].mean(), (one[:, f].mean() - two[:, f].mean()) / math.sqrt(e1 + e2)))
    return out


def test_heldout_signatures(spark):
    rng = np.random.default_rng(11)
    n = 90
    x = rng.normal(100, 1, (n, 8))
    x[: n // 2, :3] += 4
    label = ["up" if i < n // 2 else "down" for i in range(n)]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "unit int, v array<double>").repartition(3)
    ref = spark.createDataFrame(list(enumerate(label)), "unit int, label string")
    got = {(r.cluster, r.feature): r for r in C.heldout_signatures(df, "unit", "v", 2, 9, reference=ref).collect()}
    picks = df.selectExpr("unit", "explode(sequence(1, 9)) rep").where("pmod(xxhash64(3, rep, unit), 1000) < 500").collect()
    told = _heldout_brute(x, list(range(n)), {rep: sorted(r.unit for r in picks if r.rep == rep) for rep in range(1, 10)}, 2, label)
    for key in {(c, f) for _, c, f, *_ in told}:
        own = [t for t in told if t[1:3] == key]
        assert got[key].n_splits_tested == len(own) and math.isclose(got[key].mean_lfc, np.mean([t[3] for t in own]), rel_tol=1e-9, abs_tol=1e-9)
        assert (got[key].frac_splits_sig == 1.0) == (key[1] < 3) and (got[key].median_p < 1e-4) == (key[1] < 3)
    again = {(r.cluster, r.feature): r for r in C.heldout_signatures(df, "unit", "v", 2, 9, reference=ref).collect()}
    assert again == got
    assert C.heldout_signatures(df.limit(0), "unit", "v", 2, 3).count() == 0


def test_heldout_signatures_of_noise(spark):
    """Without any structure at most a twentieth of the tests at that level is passed: clusters are of other units, and units are assigned by other features."""
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(0, 1, (160, 12)))], "unit int, v array<double>")
    rows = C.heldout_signatures(df, "unit", "v", 2, 12, leave_out=True).collect()
    assert len(rows) > 10 and np.mean([r.frac_splits_sig for r in rows]) <= 0.05 and np.mean([r.fdr_of_median < 0.05 for r in rows]) <= 0.05


def test_factorisation(spark):
    rng = np.random.default_rng(4)
    w, h = rng.gamma(0.5, 1, (150, 3)), rng.gamma(0.4, 1, (3, 20))
    v = w @ h
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "unit int, v array<double>").repartition(5)
    weights, components, errors = C.factorised(df, "unit", "v", 3, rounds=40, inner=25)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(errors, errors[1:], strict=False)) and errors[-1] < 1e-3 * (v**2).sum()
    got = np.array([r.weights for r in sorted(weights.collect())])
    assert (got >= 0).all() and (components >= 0).all() and not got[7].any()
    assert math.isclose(((v - got @ components) ** 2).sum(), errors[-1], rel_tol=1e-2, abs_tol=1e-6 * (v**2).sum())
    cos = (components / np.linalg.norm(components, axis=1)[:, None]) @ (h / np.linalg.norm(h, axis=1)[:, None]).T
    assert sorted(cos.argmax(1)) == [0, 1, 2] and cos.max(1).min() > 0.97  # the planted components
    with pytest.raises(ValueError):
        C.factorised(spark.createDataFrame([(1, [1.0, -1.0])], "unit int, v array<double>"), "unit", "v", 1)
    empty, none, no = C.factorised(df.limit(0), "unit", "v", 2)
    assert empty.count() == 0 and none.shape == (2, 0) and no == []
