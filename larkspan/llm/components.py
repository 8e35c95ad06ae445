"""Connected components of a graph of edges: a union-find in each part of the edges, then alternating large and small stars (Kiveris et al.) over what is left.

Nothing is gathered on the driver but sums; a task holds PART edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import cut


PART = 1 << 18


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of one part as stars: each node with the least node of its component here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = root[min(a, b)] = min(a, b)
    u = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array([find(x) for x in u], pa.int64())], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def _star(und: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and its neighbours; the minimum is taken before the shuffle too."""
    least = und.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return und.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) of every node of an edge, root being the component's least node.

    edges: two long columns; loops, repeats and rows with a null are ignored. An edgeless graph gives no rows.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e = cut(e)
    parts = -(-e.count() // PART)
    if parts:
        e = cut(e.repartition(parts).mapInArrow(_forest, "u long, v long"))
    before = _state(e) if parts > 1 else None
    for _ in range(most_rounds if parts > 1 else 0):
        both = e.union(e.select("v", "u"))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _star(large)
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        if parts > 1:
            raise RuntimeError(f"no components after {most_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
