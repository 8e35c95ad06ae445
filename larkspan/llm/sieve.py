"""A bit sieve of bounded size for 64-bit keys: what it lets through may be a member, what it stops is none."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 26  # 8 MB: the bound of what is broadcast, however many keys there are


def probes(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = key.astype(np.uint64, copy=False)
    return (u & np.uint64(bits - 1)).astype(np.int64), ((u >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def build(keys: DataFrame, key: str) -> np.ndarray:
    """The sieve of a long column: bits as uint64 words, made by aggregation, so that the driver gets MOST_BITS at most."""
    n = max(1, keys.agg(F.approx_count_distinct(key)).first()[0])
    bits = min(MOST_BITS, max(1 << 12, 1 << (32 * n - 1).bit_length()))
    at = F.explode(F.array(F.col(key).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1))))
    each = keys.select(at.alias("b")).select((F.col("b") + 1).alias("b"))  # bitmaps of 32768 bits, numbered from 1
    maps = each.groupBy(F.bitmap_bucket_number("b").alias("w")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("v"))
    size = min(bits >> 3, 1 << 12)
    out = np.zeros(max(1, bits >> 15) * size, np.uint8)
    for r in maps.collect():
        out[(r.w - 1) * size : r.w * size] = np.frombuffer(bytes(r.v), np.uint8)[:size]
    out = out.view(np.uint64)
    return out


def passes(sieve: np.ndarray, key: np.ndarray) -> np.ndarray:
    a, b = probes(key, len(sieve) << 6)
    one = np.uint64(1)
    bit = lambda p: (sieve[p >> 6] >> (p & 63).astype(np.uint64)) & one
    return (bit(a) & bit(b)).astype(bool)


def apart(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose key is surely none of ``keys``, as they are, and the rest, which a join has to tell. Only keys go through Python."""
    held = rows.sparkSession.sparkContext.broadcast(build(keys, key))

    @F.pandas_udf("boolean")
    def maybe(k: pd.Series) -> pd.Series:
        return pd.Series(passes(held.value, k.to_numpy(np.int64)))

    return rows.where(~maybe(key)), rows.where(maybe(key))
