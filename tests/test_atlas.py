"""Footers, pruning, scans that go on, and the pivot."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.sources import atlas


@pytest.fixture
def shards(spark, tmp_path):
    rows = [(f"line{i % 12:02d}", f"g{i % 7}", "AB"[i % 2], float(i)) for i in range(600)] + [(None, "g0", "A", 1.0)]
    df = spark.createDataFrame(rows, "line string, gene string, arm string, lfc double")
    for k in range(12):
        df.where(F.col("line") == f"line{k:02d}").coalesce(1).write.mode("append").parquet(str(tmp_path / "de"))
    df.where("line is null").coalesce(1).write.mode("append").parquet(str(tmp_path / "de"))
    return rows, str(tmp_path)


def test_footers_and_their_index(spark, shards):
    _, at = shards
    index = atlas.footer_index(spark, f"{at}/de", "line", f"{at}/index")
    got = sorted((r.lo or "", r.hi or "", r.n_rows, r.known) for r in index.collect())
    assert got == [("", "", 1, True)] + [(f"line{k:02d}", f"line{k:02d}", 50, True) for k in range(12)]
    opened = []
    plain = atlas.footers
    try:
        atlas.footers = lambda files, column: opened.append(files.count()) or plain(files, column)
        spark.createDataFrame([("line99", "g1", "A", 2.0)], "line string, gene string, arm string, lfc double").coalesce(1).write.mode("append").parquet(f"{at}/de")
        assert atlas.footer_index(spark, f"{at}/de", "line", f"{at}/index").count() == 14 and opened == [1]
    finally:
        atlas.footers = plain
    sizes = atlas.shard_sizes(atlas.shard_files(spark, f"{at}/de")).first()
    assert sizes.n_files == 14 and sizes.least <= sizes["median"] <= sizes.largest
    unknown = atlas.footers(spark.createDataFrame([("nowhere://x/y.parquet", 1, 1)], "shard string, size long, modified long"), "line").first()
    assert not unknown.known and unknown.lo is None
    assert [r.shard for r in atlas.shards_for(spark.createDataFrame([unknown], atlas.INDEX), spark.createDataFrame([("a",)], "value string"), "string").collect()] == ["nowhere://x/y.parquet"]


def test_covering_ranges(spark):
    rnd = random.Random(2)
    for kind, make in (("long", lambda: rnd.randrange(200)), ("string", lambda: f"k{rnd.randrange(200):04d}")):
        ranges = [(i, *sorted((make(), make()))) for i in range(120)] + [(500, None, make()), (501, make(), None)]
        values = [make() for _ in range(15)] + [None]
        index = spark.createDataFrame(ranges, f"shard long, lo {kind}, hi {kind}")
        got = {r.shard for r in atlas.covering(index, spark.createDataFrame([(v,) for v in values], f"value {kind}")).collect()}
        assert got == {i for i, a, b in ranges if a is not None and b is not None and any(v is not None and a <= v <= b for v in values)}
        plan = atlas.covering(index, spark.createDataFrame([(v,) for v in values], f"value {kind}"))._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert atlas.covering(index, spark.createDataFrame([], f"value {kind}")).count() == 0


def test_scan_goes_on_and_tells_failures(spark, shards, tmp_path):
    _, at = shards
    names = [r.shard for r in atlas.shard_files(spark, f"{at}/de").collect()]
    calls = []

    def broken(df):
        calls.append(1)
        if len(calls) > 1:
            raise RuntimeError("the machine was lost")
        return df

    first = atlas.scan(spark, names, f"{at}/out", broken, batch=5)
    assert first.where("state = 'done'").count() == 5 and first.where("state = 'failed'").count() == 8 and "lost" in first.where("state = 'failed'").first().error
    again = atlas.scan(spark, names, f"{at}/out", lambda df: df, batch=5)
    assert again.groupBy("state").count().orderBy("state").collect() == [("before", 5), ("done", 8)]
    assert atlas.scanned(spark, f"{at}/out").count() == 601
    (tmp_path / "de" / "bad.parquet").write_bytes(b"no parquet")
    bad = atlas.scan(spark, [r.shard for r in atlas.shard_files(spark, f"{at}/de").collect()], f"{at}/other", lambda df: df, batch=20)
    assert bad.where("state = 'failed'").count() == 1 and atlas.scanned(spark, f"{at}/other").count() == 601


def test_atlas_pivot(spark, shards):
    rows, at = shards
    values = spark.createDataFrame([("line03",), ("line07",), ("line70",), ("line03",)], "v string")
    out, report = atlas.atlas(spark, f"{at}/de", f"{at}/index", "line", values, "string", F.col("lfc") > 50, "gene", "arm", "lfc", ["A", "B", "C"])
    assert tuple(report.first()) == (13, 2, 0)
    got = {r.gene: (r.A, r.B, r.C) for r in out.collect()}
    mean = lambda v: sum(v) / len(v) if v else None
    pick = lambda g, a: mean([x for line, gene, arm, x in rows if line in ("line03", "line07") and gene == g and arm == a and x > 50])
    assert got == {g: (pick(g, "A"), pick(g, "B"), None) for g in {f"g{i}" for i in range(7)}}
    none, report = atlas.atlas(spark, f"{at}/de", f"{at}/index", "line", values.limit(0), "string", F.lit(True), "gene", "arm", "lfc", ["A"])
    assert none.count() == 0 and tuple(report.first()) == (13, 0, 0)
