"""Density clustering: nearest neighbours, a spanning tree grown by components, then the condensed tree of it.

Every component of points is joined by its least edge to another one, again and again (Boruvka). The neighbours found at first tell most of these edges; where a point may have a lesser edge than its component's least known one, all
points are searched for it. Points meet each other block by block in tasks, and only what is best for a point leaves them: no table of pairs is made, shuffled or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.lineage import Steps

BLOCK = 1024  # points of a block; a task holds two blocks and a table of their distances
PART = 1 << 17  # points that a task has its own blocks meet, one block after the other
LEFT_PARTS = 256
CHUNK_EDGES = 1 << 20  # edges whose spanning forest a task finds
MOST_POINTS = 4_000_000  # the condensed tree is built of one edge for each point in one task; more are refused
SPARE = 8  # neighbours kept beyond min_samples, for the edges of the first rounds


def _packed(points: DataFrame, side: str, names: list[str]) -> DataFrame:
    """Each block as one row of binary columns."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{f"{side}x": np.stack(g.x.to_numpy()).astype(float).tobytes()} | {side + c: g[c].to_numpy().tobytes() for c in names}])

    return points.select("block", "x", *names).groupBy("block").applyInPandas(run, ", ".join(f"{side}{c} binary" for c in ["x", *names]))


class _Block:
    """Points of a packed row; those of the own side gather what is best for each of them."""

    def __init__(self, batch: pa.RecordBatch, row: int, side: str, names: list[str]):
        get = lambda c, kind: np.array(np.frombuffer(batch.column(side + c)[row].as_buffer(), kind))
        for c in names:
            setattr(self, c, get(c, np.int64 if c in ("i", "comp") else float))
        self.x = get("x", float).reshape(len(self.i), -1)
        self.norm = (self.x**2).sum(1)
        self.row, self.d, self.j = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def about(self, far: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by a product, and twice the most they can be wrong by, for each row."""
        return self.norm[:, None] + far.norm[None] - 2 * (self.x @ far.x.T), 8 * (self.x.shape[1] + 4) * np.finfo(float).eps * (self.norm + far.norm[np.isfinite(far.norm)].max(initial=0.0))

    def exact(self, far: _Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Distances of some pairs by differences, so that equal points are exactly 0 apart and both directions agree."""
        out = np.zeros(len(r))
        for k in range(self.x.shape[1]):
            out += (self.x[r, k] - far.x[c, k]) ** 2
        return np.sqrt(out)

    def keep(self, r: np.ndarray, d: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """The least ``most`` of each row, old and new; returns how many each row has."""
        r, d, j = np.concatenate([self.row, r]), np.concatenate([self.d, d]), np.concatenate([self.j, j])
        order = np.lexsort((j, d, r))
        r, d, j = r[order], d[order], j[order]
        first = np.arange(len(r)) - np.searchsorted(r, np.arange(len(self.i)))[r] < most
        self.row, self.d, self.j = r[first], d[first], j[first]
        return np.bincount(self.row, minlength=len(self.i))


def _near(k: int) -> Callable[[_Block, _Block], None]:
    def meet(own: _Block, far: _Block) -> None:
        """The k nearest others of each point."""
        d2, wrong = own.about(far)
        limit = getattr(own, "limit", np.full(len(own.i), np.inf)) + wrong
        close = d2 <= limit[:, None]
        if d2.shape[1] > k + 1 and close.sum() > 8 * k * len(own.i):
            close = d2 <= np.minimum(limit, np.partition(d2, k, axis=1)[:, k] + wrong)[:, None]  # one more than k: the point itself
        r, c = np.nonzero(close)
        other = own.i[r] != far.i[c]
        r, c = r[other], c[other]
        full = own.keep(r, own.exact(far, r, c), far.i[c], k) == k
        own.limit = np.full(len(own.i), np.inf)
        own.limit[full] = own.d[np.searchsorted(own.row, np.flatnonzero(full), "right") - 1] ** 2

    return meet


def _outward(own: _Block, far: _Block) -> None:
    """The least edge of each point to another component, if it is less than the bound."""
    d2, wrong = own.about(far)
    w2 = np.maximum(np.maximum(d2, far.core[None] ** 2), own.core[:, None] ** 2)
    w2[own.comp[:, None] == far.comp[None]] = np.inf
    least = w2.min(1)
    r, c = np.nonzero(w2 <= np.where(np.isfinite(least), np.minimum(least, own.bound**2) + wrong, -1.0)[:, None])
    w = np.maximum(np.maximum(own.exact(far, r, c), own.core[r]), far.core[c])
    less = w < own.bound[r]
    own.keep(r[less], w[less], far.i[c][less], 1)
    own.bound[own.row] = own.d


def _met(points: DataFrame, count: int, others: DataFrame, n: int, names: list[str], more: list[str], meet: Callable[[_Block, _Block], None]) -> DataFrame:
    """Rows (i, d, j) of what each of ``count`` points keeps of those in each part of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bytes, _Block] = {}  # the few blocks of this task
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("l_i")[row].as_py()
                if key not in own:
                    own[key] = _Block(batch, row, "l_", [*names, *more])
                meet(own[key], _Block(batch, row, "r_", names))
        for b in own.values():
            ends = np.searchsorted(b.row, np.arange(len(b.i) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b.i), pa.ListArray.from_arrays(ends, pa.array(b.d)), pa.ListArray.from_arrays(ends, pa.array(b.j))], ["i", "d", "j"])

    blocks = -(-count // BLOCK)
    left = _packed(points.withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")), "l_", [*names, *more]).repartition(min(blocks, LEFT_PARTS))
    right = _packed(others, "r_", names).repartition(-(-n // PART))
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, "i long, d array<double>, j array<long>")


def _root(up: dict, v: int) -> int:
    top = v
    while (nxt := up.get(top, top)) != top:
        top = nxt
    while (nxt := up.get(v, v)) != top:
        up[v], v = top, nxt
    return top


def _forest(g: pd.DataFrame) -> pd.DataFrame:
    """The minimum spanning forest of the edges, by Kruskal."""
    g = g[["a", "b", "w"]].drop_duplicates().sort_values(["w", "a", "b"])
    up: dict[int, int] = {}
    keep = np.zeros(len(g), bool)
    for n, (a, b) in enumerate(zip(g.a.tolist(), g.b.tolist(), strict=True)):
        a, b = _root(up, a), _root(up, b)
        if a != b:
            up[a] = b
            keep[n] = True
    return g[keep]


def _joined(g: pd.DataFrame) -> pd.DataFrame:
    """Edges that join components, least first, without those that close a circle, and the new name of each component."""
    up: dict[int, int] = {}
    kept, seen = [], set()
    g = g.sort_values(["w", "a", "b"])
    for a, b, w, x, y in zip(g.a.tolist(), g.b.tolist(), g.w.tolist(), g.ca.tolist(), g.cb.tolist(), strict=True):
        seen |= {x, y}
        x, y = _root(up, x), _root(up, y)
        if x != y:
            up[x] = y
            kept.append((-1, -1, a, b, w))
    return pd.DataFrame(kept + [(c, _root(up, c), -1, -1, 0.0) for c in seen], columns=["comp", "name", "a", "b", "w"])


def condensed_labels(edges: pd.DataFrame, least: int) -> dict[int, int]:
    """Cluster of each node of a spanning tree, named by its least node; nodes of no cluster are left out.

    Edges of one weight go at once. A part of ``least`` nodes or more is a cluster's; where a cluster falls into several such parts it ends and they begin, else what falls off leaves it. A cluster's stability sums over
    its nodes how long each stays, in 1 / distance; from the leaves up, a cluster is taken if its stability is at least that of its best descendants together. The whole is not taken as one cluster.
    """
    g = edges.sort_values(["w", "a", "b"])
    up: dict[int, int] = {}
    node: dict[int, int] = {}  # by root: the number of its dendrogram node
    kids: list[list[int]] = []
    at: list[float] = []
    size: list[int] = []
    leaf: list[int] = []

    def new(weight: float, children: list[int], count: int, own: int = -1) -> int:
        kids.append(children)
        at.append(weight)
        size.append(count)
        leaf.append(own)
        return len(kids) - 1

    top = -1
    for a, b, w in zip(g.a.tolist(), g.b.tolist(), g.w.tolist(), strict=True):
        ra, rb = _root(up, a), _root(up, b)
        x, y = (node[r] if r in node else new(0.0, [], 1, r) for r in (ra, rb))
        parts = [*(kids[x] if at[x] == w and leaf[x] < 0 else [x]), *(kids[y] if at[y] == w and leaf[y] < 0 else [y])]
        up[ra] = rb
        node[rb] = top = new(w, parts, size[x] + size[y])
    if top < 0:
        return {}

    def leaves(of: int) -> list[int]:
        out, todo = [], [of]
        while todo:
            v = todo.pop()
            if leaf[v] >= 0:
                out.append(leaf[v])
            todo += kids[v]
        return out

    lam = lambda w: 1 / max(w, 1e-12)
    parent, birth, stable, start = [-1], [0.0], [0.0], [top]
    todo = [(top, 0)]
    while todo:
        v, c = todo.pop()
        while True:
            big = [k for k in kids[v] if size[k] >= least]
            now = lam(at[v])
            gone = size[v] if len(big) != 1 else size[v] - size[big[0]]
            stable[c] += gone * (now - birth[c])
            if len(big) == 1:
                v = big[0]
                continue
            for k in big:
                parent.append(c)
                birth.append(now)
                stable.append(0.0)
                start.append(k)
                todo.append((k, len(parent) - 1))
            break
    best, chosen = stable[:], [True] * len(parent)
    below = [0.0] * len(parent)
    has = [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):  # children have greater numbers
        if has[c] and below[c] > stable[c]:
            chosen[c], best[c] = False, below[c]
        below[parent[c]] += best[c]
        has[parent[c]] = True
    chosen[0] = False
    taken = [False] * len(parent)
    label: dict[int, int] = {}
    for c in range(1, len(parent)):
        taken[c] = taken[parent[c]] or chosen[c]
        if chosen[c] and not taken[parent[c]]:
            own = leaves(start[c])
            first = min(own)
            label.update(dict.fromkeys(own, first))
    return label


def _written(steps: Steps, met: DataFrame) -> DataFrame:
    """Written with few rows in an Arrow batch, for a row has two blocks."""
    conf, name = steps.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = conf.get(name)
    conf.set(name, "16")
    try:
        return steps.write(met)
    finally:
        conf.set(name, usual)


def _thinned(steps: Steps, edges: DataFrame) -> DataFrame:
    """Without edges that are the greatest of a circle, as far as tasks see one."""
    count = edges.count()
    while count > CHUNK_EDGES:
        parts, old = -(-count // CHUNK_EDGES), edges
        edges = steps.write(edges.withColumn("part", F.pmod(F.xxhash64(F.lit(parts), F.least("a", "b")), F.lit(parts))).groupBy("part").applyInPandas(_forest, "a long, b long, w double"))
        steps.drop(old)
        before, count = count, edges.count()
        if count * 10 > before * 9:
            break
    return edges


def _spanning_tree(steps: Steps, points: DataFrame, n: int, min_samples: int) -> DataFrame:
    """Rows (a, b, w): a minimum spanning tree of the points (i, x, block) by mutual reachability."""
    k, never = min_samples + SPARE, F.lit(float("inf"))
    met = _written(steps, _met(points, n, points, n, ["i"], [], _near(k)))
    near = steps.write(met.groupBy("i").agg(F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "j")))), 1, k).alias("near")))
    steps.drop(met)
    core = near.where(F.size("near") >= min_samples).select("i", F.element_at("near", min_samples)["d"].alias("core"), F.when(F.size("near") == k, F.element_at("near", -1)["d"]).otherwise(never).alias("reach"))
    at = steps.write(core.select("i", "core", F.col("i").alias("comp"), F.greatest("core", "reach").alias("floor")))  # floor: no edge that isn't known is less
    cores = at.select("i", "core")
    listed = near.select("i", F.explode("near").alias("e")).select(F.col("i").alias("a"), F.col("e.j").alias("b"), F.col("e.d").alias("d"))
    weighed = listed.join(cores.toDF("a", "ka"), "a").join(cores.toDF("b", "kb"), "b").select("a", "b", F.greatest("d", "ka", "kb").alias("w"))
    known = _thinned(steps, steps.write(weighed))
    steps.drop(near)
    tree = None
    while True:
        names = at.select("i", "comp")
        old, known = known, steps.write(known.select("a", "b", "w").join(names.toDF("a", "ca"), "a").join(names.toDF("b", "cb"), "b").where("ca <> cb"))
        steps.drop(old)
        edge = F.struct("w", "a", "b", "ca", "cb").alias("e")
        best = steps.write(known.select(F.col("ca").alias("comp"), edge).union(known.select(F.col("cb").alias("comp"), edge)).groupBy("comp").agg(F.min("e").alias("e")))
        bound = F.coalesce("e.w", never)
        by_comp = at.groupBy("comp").agg(F.min("floor").alias("floor")).join(best, "comp", "left")
        count, open_ = by_comp.agg(F.count("*"), F.count_if(F.col("floor") < bound)).first()
        if count <= 1:
            return tree if tree is not None else known.select("a", "b", "w")
        if 2 * open_ > count:
            searched = steps.write(at.join(best, "comp", "left").select("i", "core", "comp", bound.alias("bound")).where(F.col("floor") < F.col("bound")))
            m = searched.count()
            met = _written(steps, _met(points.drop("block").join(searched, "i"), m, points.join(at.select("i", "core", "comp"), "i"), n, ["i", "core", "comp"], ["bound"], _outward))
            found = steps.write(met.where(F.size("d") > 0).groupBy(F.col("i").alias("a")).agg(F.min(F.struct(F.col("d")[0].alias("w"), F.col("j")[0].alias("b"))).alias("f")).select("a", "f.b", "f.w"))
            old, at = at, steps.write(at.join(searched.select("i", "bound"), "i", "left").join(found.select(F.col("a").alias("i"), "w"), "i", "left").select("i", "core", "comp", F.coalesce("w", "bound", "floor").alias("floor")))
            for x in (old, met, searched, best):
                steps.drop(x)
            known = steps.write(known.select("a", "b", "w").union(found))
            continue
        chosen = by_comp.where(F.col("e").isNotNull() & (F.col("floor") >= bound)).select("e.*").distinct()
        told = steps.write(chosen.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_joined, "comp long, name long, a long, b long, w double"))  # one row a component
        added = told.where("comp < 0").select("a", "b", "w")
        if added.isEmpty():
            return tree if tree is not None else added
        tree = steps.write(added, "tree")
        old, at = at, steps.write(at.join(told.where("comp >= 0").select("comp", "name"), "comp", "left").select("i", "core", F.coalesce("name", "comp").alias("comp"), "floor"))
        for x in (old, best, told):
            steps.drop(x)


def hdbscan(df: DataFrame, id_col: str, array: str, min_samples: int = 5, min_cluster: int = 5) -> DataFrame:
    """Rows (id_col, cluster): clusters from 0 by their least id, -1 for noise, by density: hierarchical single linkage of mutual reachability, the condensed tree and the stablest clusters of it.

    A point's core distance is that to its min_samples-th nearest other point; two points' mutual reachability is the greatest of both core distances and their own. Equal distances are handled at once, so the order of rows
    has no part in the result. Ids must be unique; rows with a null id or array are left out. No more than min_samples points are all noise. No rows give no rows.

    Work grows with the square of the points, as exact density clustering in many dimensions does, but tables don't: what is shuffled and written is some rows for each point and for each part of PART points that it meets.
    """
    spark = df.sparkSession
    steps = Steps(spark)
    points = df.select(F.col(id_col).alias("id"), F.col(array).cast("array<double>").alias("x")).where("id is not null and x is not null")
    n = points.count()
    if n > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points")
    kind = dict(df.dtypes)[id_col]
    if n <= min_samples:
        return points.select(F.col("id").alias(id_col), F.lit(-1).alias("cluster"))
    blocks = -(-n // BLOCK)
    points = steps.write(points.repartitionByRange(blocks, "id").sortWithinPartitions("id").withColumn("i", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int")))
    edges = _spanning_tree(steps, points.select("i", "x", "block"), n, min_samples)

    def labelled(g: pd.DataFrame) -> pd.DataFrame:
        label = condensed_labels(_forest(g), min_cluster)
        return pd.DataFrame({"i": list(label), "c": list(label.values())}, dtype=np.int64)

    told = steps.write(edges.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(labelled, "i long, c long"))  # one row a point, MOST_POINTS at most
    numbers = told.groupBy("c").agg(F.min("i").alias("first")).select("c", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))  # one row for each cluster
    return points.join(told, "i", "left").join(numbers, "c", "left").select(F.col("id").cast(kind).alias(id_col), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
