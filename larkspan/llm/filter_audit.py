"""Operator 11, filter interaction audit by Walsh-Hadamard sums.

Each document has a mask of the filters that it fails. For each part and label, one signed sum for each of the 2**n parities of the mask is aggregated; the
transform is its own inverse but for a factor, so the sums give back how many documents have each mask, exactly. Every order of the filters is then evaluated on those cells,
and so is the Shapley value, for of the filters that a document fails each comes first in the same number of orders.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"
MOST_FILTERS = 6  # 720 orders; each filter more multiplies the result


def text_filters(text: Column, min_words: int = 50, distinct_share: int = 65, capital_share: int = 5, symbols: str = "[#$%&*|]") -> dict[str, Column]:
    """The failure conditions A to D of a text that isn't null, shares in percent: few words, few different words, many capitals, odd symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < min_words,
        "B": 100 * F.size(F.array_distinct(words)) < distinct_share * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > capital_share * F.length(text).cast("long"),
        "D": text.rlike(symbols),
    }


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Rows (part, good, toxic, mask), one for each document.

    Bit i of the mask is set where filter i of ``filters`` (given over the columns __text, which is never null, and those of ``docs``) fails; the next bit is the filter named ``copies``: the text is also that of a
    smaller id. A filter that gives null doesn't fail. A null text is an empty one, a null part an empty string; a null id is neither smaller nor larger than another one.
    ``labels`` has columns doc_id, quality and toxic; a document is good (toxic) if any row of its id says 1.

    Only ids, digests and masks are shuffled. The least id of each text is found by an aggregation and joined on both, so copies of one text meet in no task.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    frame = docs.withColumn("__text", text)
    filters = text_filters(F.col("__text")) if filters is None else filters
    bits = sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))
    id_ = F.col(f"`{id_col}`")
    rows = frame.select(id_.alias("__id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2("__text", 256)).alias("digest"), bits.cast("int").alias("mask"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = cut(rows)
    least = rows.where("__id is not null").groupBy("digest").agg(F.min("__id").alias("__id")).withColumn("first", F.lit(True))
    known = rows.where("__id is not null").join(least, ["digest", "__id"], "left").join(said, "__id", "left")
    bit = 1 << len(filters)
    known = known.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), (F.col("mask") + F.when(F.col("first"), 0).otherwise(bit)).alias("mask"))
    unknown = rows.where("__id is null").select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask")
    return known.unionByName(unknown)


def _sign(a: str, b: str | int) -> str:
    """SQL of -1 where an odd number of bits is set in both, else 1."""
    return f"cast(1 - 2 * (bit_count({a} & {b}) & 1) as bigint)"


def cells(masked: DataFrame, n_filters: int) -> DataFrame:
    """Rows (part, good, toxic, n): n is an array of the number of documents of each mask from 0 to 2**n_filters - 1, inverted from the signed parity sums."""
    size = 1 << n_filters
    sums = [F.expr(f"sum({_sign('mask', s)}) w{s}") for s in range(size)]
    told = masked.groupBy("part", "good", "toxic").agg(*sums).selectExpr("part", "good", "toxic", f"array({', '.join(f'w{s}' for s in range(size))}) w")
    index = f"sequence(0, {size - 1})"
    return told.selectExpr("part", "good", "toxic", f"transform({index}, m -> shiftright(aggregate({index}, 0L, (a, s) -> a + {_sign('m', 's')} * w[s]), {n_filters})) n")


def _states(names: list[str]) -> dict[tuple[int, int], list[tuple[str, int]]]:
    """By bit of a filter and mask of those before it: the (order, step) in which it stands so."""
    out: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order, 1):
            out.setdefault((1 << i, before), []).append(("".join(names[j] for j in order), step))
            before |= 1 << i
    return out


def audit(masked: DataFrame, names: list[str]) -> DataFrame:
    """Rows (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order of ``names`` and step, zeros included.

    masked: rows (part, good, toxic, mask) as of masks(). Counts are of documents within the part: kept after the step, removed by its filter, redundant (fail it but were removed earlier), fail no other
    filter, removed good and toxic ones; shapley is what the filter removes, summed over all orders. No documents give no rows. An order names each filter by its name; up to MOST_FILTERS.
    """
    n = len(names)
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {n}")
    size = 1 << n
    told = cells(masked, n)
    pick = lambda c, weight: f"array({', '.join(f'sum({weight} * n[{m}])' for m in range(size))}) {c}"
    parts = told.groupBy("part").agg(*(F.expr(pick(c, w)) for c, w in (("n", "1"), ("good", "int(good)"), ("toxic", "int(toxic)"))))
    states = json.dumps([{"b": b, "e": e, "turns": [{"o": o, "k": k} for o, k in v]} for (b, e), v in _states(names).items()])
    rows = parts.withColumn("s", F.explode(F.from_json(F.lit(states), "array<struct<b:int,e:int,turns:array<struct<o:string,k:int>>>>")))
    orders = f"array({', '.join(f'{factorial(n) // max(1, i)}L' for i in range(n + 1))})"  # in which one of i filters is the first of them
    total = lambda cell, when: f"aggregate(sequence(0, {size - 1}), 0L, (a, m) -> a + if({when}, {cell}, 0L))"
    here, earlier = "(m & s.b) <> 0", "(m & s.e) <> 0"
    told = rows.selectExpr(
        "part",
        "s.turns",
        f"{total('n[m]', f'not {here} and not {earlier}')} kept",
        f"{total('n[m]', f'{here} and not {earlier}')} removed",
        f"{total('n[m]', f'{here} and {earlier}')} redundant",
        "n[s.b] unique_fails",
        f"{total('good[m]', f'{here} and not {earlier}')} good_lost",
        f"{total('toxic[m]', f'{here} and not {earlier}')} toxic_lost",
        f"{total(f'n[m] * {orders}[bit_count(m)]', here)} shapley",
    )
    counts = [c for c in told.columns if c not in ("part", "turns")]
    return told.select("part", F.explode("turns").alias("t"), *counts).select("part", F.col("t.o").alias("filter_order"), F.col("t.k").alias("step"), *counts)
