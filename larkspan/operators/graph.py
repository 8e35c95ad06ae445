"""Graph operators over an edge table (src, dst): joins and aggregations; breadth-first steps write their state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.lineage import Steps


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes one step away in any direction; nodes: (id)."""
    return upstream(edges, nodes).union(downstream(edges, nodes)).distinct()


def upstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def downstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, n: int, nodes: DataFrame | None = None) -> DataFrame:
    """The n nodes of the largest degree, cut to ``nodes`` afterwards."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(n)
    return top if nodes is None else top.join(nodes, "id", "left_semi")


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def toggled(visible: DataFrame, edges: DataFrame, node: DataFrame) -> DataFrame:
    """Visible ids after opening a node; if its neighbours are visible already, without those that hang on it alone."""
    near = neighbours(edges, node)
    hidden = near.join(visible, "id", "left_anti")
    if not hidden.isEmpty():
        return visible.union(hidden).distinct()
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = induced(both, visible).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n"))
    return visible.join(near.join(links.where("n = 1"), "id", "left_semi"), "id", "left_anti")


def simple_paths(edges: DataFrame, starts: DataFrame, goals: DataFrame, most: int = 8, limit: int | None = None) -> DataFrame:
    """Paths without repeated nodes of up to ``most`` edges from a start to a goal, shortest first.

    A path stops at its first goal. Each round is one join of the open paths with the edges.
    """
    open_paths = starts.select(F.array("id").alias("path"), F.col("id").alias("at"))
    goal = goals.select(F.col("id").alias("at")).distinct()
    found = None
    for _ in range(most):
        step = open_paths.join(edges.select(F.col("src").alias("at"), "dst"), "at").where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        done = step.join(goal, "at", "left_semi").select("path")
        found = done if found is None else found.union(done)
        open_paths = step.join(goal, "at", "left_anti")
    out = found.select("path", (F.size("path") - 1).cast("long").alias("n_edges")).distinct()
    return out if limit is None else out.orderBy("n_edges", "path").limit(limit)


PART_EDGES = 1 << 18


def _expanded(edges: pd.DataFrame, frontier: pd.DataFrame) -> pd.DataFrame:
    """Every node that the frontier reaches over the edges of one part."""
    out: dict = {}
    for a, b in zip(edges.src, edges.dst, strict=True):
        out.setdefault(a, []).append(b)
    seen, stack = set(), list(frontier.id)
    while stack:
        for b in out.get(stack.pop(), ()):
            if b not in seen:
                seen.add(b)
                stack.append(b)
    return pd.DataFrame({"id": pd.Series(list(seen), dtype=frontier.id.dtype if frontier.id.dtype.kind in "iu" else object), "part": frontier.part.iloc[0] if len(frontier) else 0})


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Every node that can be reached from the starts, themselves included.

    Edges are dealt by their source to parts of PART_EDGES, about. In a round each part follows the frontier as far as its own edges go, and what is new to all and has its edges elsewhere is the next
    frontier; it ends when there is none, however long the paths are, and cycles do no harm. A round's cost is linear in the edges of the parts that it reaches, and its rows are written, so
    plans don't grow. Of one node with very many edges the part grows with them; edges with a null are ignored, null starts too. Starts without edges are all there is of them.
    """
    spark = edges.sparkSession
    steps = Steps(spark)
    kind = dict(edges.dtypes)["src"]
    links = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct()
    parts = max(1, -(-links.count() // PART_EDGES))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    links = steps.write(links.withColumn("part", deal("src")))
    fresh = starts.select(F.col("id").cast(kind).alias("id")).where("id is not null").distinct()
    seen = steps.write(fresh, "seen")
    frontier = seen.withColumn("part", deal("id"))
    while True:
        reached = links.groupBy("part").cogroup(frontier.groupBy("part")).applyInPandas(_expanded, f"id {kind}, part int")
        new = reached.join(seen, "id", "left_anti").groupBy("id").agg(F.bool_or(F.col("part") == deal("id")).alias("done"))
        new = steps.write(new)
        if new.isEmpty():
            return seen
        seen = steps.write(new.select("id"), "seen")
        frontier = new.where("not done").select("id", deal("id").alias("part"))


def matched(nodes: DataFrame, query: str, label: str = "label") -> DataFrame:
    """Nodes of that very name, trimmed and in upper case, else of names that begin with it."""
    q = query.strip().upper()
    exact = nodes.where(F.upper(F.trim(label)) == q)
    return exact if not exact.isEmpty() else nodes.where(F.upper(F.trim(label)).startswith(q))


def presence(nodes: DataFrame, degs: DataFrame, label: str = "label", gene: str = "symbol") -> DataFrame:
    """How often each differential gene stands in the graph: none, once or multiple."""
    n = nodes.groupBy(F.col(label).alias(gene)).agg(F.count("*").alias("n_nodes"))
    out = degs.join(n, gene, "left").fillna(0, ["n_nodes"])
    return out.withColumn("presence", F.when(F.col("n_nodes") == 0, "none").when(F.col("n_nodes") == 1, "once").otherwise("multiple"))


def typed_edges(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples (src, interaction, dst) with both ends known as nodes."""
    return induced(triples, nodes)
