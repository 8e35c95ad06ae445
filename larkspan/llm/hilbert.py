"""Operator 3, sharding along a Hilbert curve, in DataFrame functions only.

Several metadata dimensions are quantised at their quantiles, a row's cell gets its index on the Hilbert curve, rows are sorted by
that index, and the order is cut into runs of equal row counts. Neighbours on the curve are neighbours in every dimension, so each
shard spans a small box of them and readers can skip shards by minimum and maximum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.shared import cut, partitions, ranked

MADE = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def curve_table(n: int) -> list[int]:
    """Steps of the n-dimensional curve: entry state * 2**n + cell holds next_state * 2**n + digit.

    A state is an entry corner e and a direction d, as e * n + d; cell is one bit of each dimension. The digit is the inverse Gray code of
    the cell, seen from the corner and direction (Hamilton's formulation).
    """
    mask = (1 << n) - 1
    turn = lambda x, k: ((x >> k % n) | (x << (n - k % n))) & mask  # noqa: E731  rotate right
    gray = lambda i: i ^ (i >> 1)
    inverse = {gray(i): i for i in range(1 << n)}
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing set bits
    table = []
    for e in range(1 << n):
        for d in range(n):
            for cell in range(1 << n):
                w = inverse[turn(cell ^ e, d + 1)]
                corner = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                step = 0 if w == 0 else ones(w if w % 2 else w - 1) % n
                e2, d2 = e ^ turn(corner, n - (d + 1) % n), (d + step + 1) % n
                table.append(((e2 * n + d2) << n) | w)
    return table


def curve_index(cells: Sequence[Column], bits: int) -> Column:
    """Index of a cell on the curve; each cell coordinate is from 0 to 2**bits - 1."""
    n = len(cells)
    table = F.array(*map(F.lit, curve_table(n)))
    states = (1 << n) * n
    at = F.array(*[c.cast("long") for c in cells])

    def step(acc: Column, level: Column) -> Column:
        bit = F.aggregate(at, F.lit(0).cast("long"), lambda a, x: a * 2 + (F.floor(x / F.pow(F.lit(2.0), level)).cast("long") % 2))
        found = F.element_at(table, ((acc % states) * (1 << n) + bit + 1).cast("int")).cast("long")
        return (F.floor(acc / states) * (1 << n) + found % (1 << n)) * states + F.floor(found / (1 << n))

    return F.floor(F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), step) / states)


def string_bounds(docs: DataFrame, name: str, cells: int) -> list[str]:
    """For i from 1 to cells - 1 the least whole value that i / cells of the rows with a value do not exceed; [] without any.

    Values are counted before they are sorted, over range partitions, so neither a hot value nor many different ones meet in one task; up to
    cells - 1 values reach the driver.
    """
    counts = docs.groupBy(F.col(f"`{name}`").alias("v")).agg(F.count("*").alias("n")).where("v is not null")
    counts = cut(counts.repartitionByRange(partitions(docs.sparkSession), "v").select("*", F.spark_partition_id().alias("part")))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    starts = counts.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(ahead), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy()).alias("total"))
    up_to = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    told = counts.withColumn("run", up_to).join(F.broadcast(starts), "part").withColumn("run", F.col("run") + F.col("before"))
    crossing = told.select("v", "total", "run", F.expr(f"(run - n) * {cells} div total").alias("low"), F.expr(f"run * {cells} div total").alias("high")).where("high > low")
    found = sorted(crossing.select("high", "v").collect())
    return [next(v for high, v in found if high >= i) for i in range(1, cells)] if found else []


def _bucket(value: Column, bounds: Sequence[float | str]) -> Column:
    """How many of the bounds are below the value; 0 for a null."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value)), F.lit(0))


def shard(docs: DataFrame, dims: Sequence[str] = ("lang", "source", "n_chars"), n_shards: int = 8, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Put every row into a shard and a slot within it, under the law "rows": counts at most one apart.

    Returns id_col, the columns named in ``keep``, and MADE (which win over input columns of the same names): size (UTF-8 bytes
    of the text plus one), text_crc32, law, shard (from 0), slot (gapless from 0 in each shard), grown_shard (null under this law) and
    curve, the index on the curve. A null text counts as empty; a null in a dimension falls in the lowest cell; whole strings are quantised, in the order of their UTF-8 bytes; a null id sorts first. Rows
    with equal keys stay apart, each with a slot of its own. An empty table gives an empty one. Long texts are only measured.

    Every row is sorted by (curve, id, crc, size) over range partitions, which also splits a hot cell; see ranked().
    """
    cells = 1 << bits
    kinds = dict(docs.dtypes)
    value = {d: F.col(f"`{d}`") if kinds[d] == "string" else (F.col(f"`{d}`").cast("timestamp") if kinds[d] == "date" else F.col(f"`{d}`")).cast("double") for d in dims}
    numeric = [d for d in dims if kinds[d] != "string"]
    found = docs.agg(F.count("*"), *[F.percentile_approx(value[d], [i / cells for i in range(1, cells)], 10_000) for d in numeric]).first()
    bounds = dict(zip(numeric, found[1:], strict=True)) | {d: string_bounds(docs, d, cells) for d in dims if kinds[d] == "string"}
    coords = [_bucket(value[d], bounds[d] or []) for d in dims]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    carried = [c for c in dict.fromkeys((id_col, *keep)) if c not in MADE]
    rows = docs.select(*[f"`{c}`" for c in carried], (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), curve_index(coords, bits).alias("curve"))
    order = ["curve", *([f"`{id_col}`"] if id_col in carried else []), "text_crc32", "size"]
    placed = ranked(rows, order).withColumn("shard", F.expr(f"cast(__rank * {n_shards} div __all as int)"))
    placed = placed.withColumn("slot", F.expr(f"__rank - (shard * __all + {n_shards - 1}) div {n_shards}")).withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))
    return placed.select(*[f"`{c}`" for c in carried], *MADE)


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write the rows with all their columns to path/shard=N/, sorted along the curve; returns pruning() of them."""
    keep = [c for c in docs.columns if c not in MADE]
    dims = options.get("dims", ("lang", "source", "n_chars"))
    placed = shard(docs, keep=keep, **options)
    placed.write.partitionBy("shard").parquet(path)
    return pruning(docs.sparkSession.read.parquet(path), dims)


def pruning(placed: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Row count, and minimum and maximum of each dimension, by shard: what a reader skips shards by."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(f"`{d}`").alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))])
