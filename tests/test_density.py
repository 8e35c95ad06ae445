"""Density clustering against thresholds on the full table of distances."""

import numpy as np
import pytest

from larkspan.operators import density


def _brute(x, k, least):
    """By components of the graph of reachability at or below each distance, from the whole down."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d + np.diag(np.full(n, np.inf)), axis=1)[:, k - 1]
    m = np.maximum(np.maximum(d, core[:, None]), core[None])
    levels = np.unique(m[np.triu_indices(n, 1)])

    def parts(own, below):
        left, out = set(own), []
        while left:
            todo = [left.pop()]
            group = list(todo)
            while todo:
                a = todo.pop()
                near = [b for b in left if m[a, b] < below]
                left.difference_update(near)
                group += near
                todo += near
            out.append(sorted(group))
        return out

    def height(own):
        lo, hi = 0, len(levels) - 1
        while lo < hi:
            mid = (lo + hi) // 2
            if len(parts(own, np.nextafter(levels[mid], np.inf))) == 1:
                hi = mid
            else:
                lo = mid + 1
        return levels[lo]

    def grow(own, birth):
        """(stability, chosen clusters) of the cluster that begins as these nodes."""
        stable, start = 0.0, own
        while True:
            w = height(own)
            lam = 1 / max(w, 1e-12)
            big = [p for p in parts(own, w) if len(p) >= least]
            stable += (len(own) - (len(big[0]) if len(big) == 1 else 0)) * (lam - birth)
            if len(big) != 1:
                break
            own = big[0]
        below = [grow(p, lam) for p in big]
        if below and sum(s for s, _ in below) > stable:
            return sum(s for s, _ in below), [c for _, cs in below for c in cs]
        return stable, [start]

    label = np.full(n, -1)
    own = list(range(n))
    while True:
        w = height(own)
        big = [p for p in parts(own, w) if len(p) >= least]
        if len(big) == 1:
            own = big[0]
            continue
        found = [c for p in big for c in grow(p, 1 / max(w, 1e-12))[1]]
        break
    for i, c in enumerate(sorted(found, key=min)):
        label[c] = i
    return label


def _cloud(n, seed, ties):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, s, (m, 2)) for c, s, m in (((0, 0), 0.4, n // 4), ((5, 5), 0.7, n // 4), ((5, 7.5), 0.4, n // 5), ((-6, 4), 1.0, n // 6))])
    x = np.concatenate([x, rng.uniform(-9, 9, (n - len(x), 2))])
    return np.round(x * 4) / 4 if ties else x


@pytest.mark.parametrize(("n", "block", "ties", "k", "least"), [(500, 1024, False, 5, 8), (300, 64, False, 4, 6), (260, 50, True, 3, 5)])
def test_hdbscan(spark, monkeypatch, n, block, ties, k, least):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "CHUNK_EDGES", 700)
    x = _cloud(n, n, ties)
    if ties:
        x[:9] = x[0]  # equal points
    want = _brute(x, k, least)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [0.0, 0.0]), (n + 5, None)], "key int, v array<double>").repartition(3)
    got = {r.key: r.cluster for r in density.hdbscan(df, "key", "v", k, least).collect()}
    assert len(got) == n and want.max() >= 2 and (want < 0).any()
    assert [got[i] for i in range(n)] == want.tolist()


def test_few_points_are_noise(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "key int, v array<double>")
    assert [r.cluster for r in density.hdbscan(df, "key", "v", 5).collect()] == [-1] * 4
    assert density.hdbscan(df.limit(0), "key", "v").count() == 0


def test_tables_grow_with_the_points_and_not_with_pairs_of_blocks(spark, monkeypatch):
    from larkspan.operators import lineage

    rows, write = [], lineage.Steps.write

    def counted(steps, df, name=None):
        out = write(steps, df, name)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage.Steps, "write", counted)
    monkeypatch.setattr(density, "BLOCK", 8)
    x = _cloud(400, 7, False)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key int, v array<double>").repartition(2)
    got = {r.key: r.cluster for r in density.hdbscan(df, "key", "v", 3, 5).collect()}
    assert [got[i] for i in range(400)] == _brute(x, 3, 5).tolist()
    assert max(rows) <= 400 * (3 + 8)  # 50 blocks: trees of all pairs of them would be 50 edges a point
