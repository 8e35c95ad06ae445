"""Operators that run in rounds, and those that had caps."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import graph, ml


def _reach(edges, starts):
    out, todo = set(starts), list(starts)
    while todo:
        a = todo.pop()
        for x, y in edges:
            if x == a and y is not None and y not in out:
                out.add(y)
                todo.append(y)
    return out


@pytest.mark.parametrize("part", [1 << 18, 40])  # at 40 edges a part, paths cross parts
def test_closure_of_random_graphs(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART_EDGES", part)
    rnd = random.Random(part)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(95)] + [(5, 5), (None, 3), (4, None), (3, 4), (3, 4)]
    e = spark.createDataFrame(edges, "src long, dst long").withColumn("id", F.lit("clash"))
    got = [r.id for r in graph.closure(e, spark.createDataFrame([(3,), (7,), (3,), (None,), (999,)], "id long")).collect()]
    assert sorted(got) == sorted(_reach(edges, [3, 7, 999]))


def test_closure_of_a_long_chain_and_a_cycle(spark):
    chain = spark.range(1000).selectExpr("concat('n', id) src", "concat('n', id + 1) dst")
    assert graph.closure(chain, spark.createDataFrame([("n0",)], "id string")).count() == 1001
    ring = spark.range(300).selectExpr("id src", "(id + 1) % 300 dst")
    assert graph.closure(ring, spark.createDataFrame([(17,)], "id long")).count() == 300
    assert graph.closure(ring.limit(0), spark.createDataFrame([(17,)], "id long")).count() == 1
    assert graph.closure(ring, spark.createDataFrame([], "id long")).count() == 0


def test_every_level_of_an_axis_is_in_the_grid(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("a", 2), (None, 1)], "x string, y int")
    got = {(r.x, r.y): (r.n, r.usable) for r in ml.feasible_states(df, ["x", "y"], 1).collect()}
    assert got == {("a", 1): (1, True), ("a", 2): (1, True), ("b", 1): (1, True), ("b", 2): (0, False), ("c", 1): (0, False), ("c", 2): (1, True)}
    with pytest.raises(ValueError):
        ml.feasible_states(df, ["x", "y"], 1, most=5)
