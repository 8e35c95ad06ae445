"""Components of the members of candidate groups, without emitting all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words as W
from larkspan.llm.components import components
from larkspan.llm.shared import cut

LONGS = 16  # 1024 parity bits a set, a column for each 64: a condition on them stays small enough to be compiled
PARITY = [f"p{i}" for i in range(LONGS)]
WIDE_FROM, WIDE_BYTES = 800, 2048  # sets of that many elements have 16384 parity bits more, which pairs are held against before their elements are
FEW = 8
MOST_KEYS = 1 << 19  # what is broadcast to pick rows by key: 4 MB of keys at most
ROUNDS, ORDERS = 2, 4  # rounds of stars in all groups, and in each the orders by which groups choose their centres
SLACK = 8  # groups with more open pairs a row than that get more rounds
YIELD = 128  # rounds of one centre end where one has linked fewer than one row of so many
MET, CENTRES = 2, 48  # rounds of many centres at most, and a group's centres in one of them, about


def parities(doc: np.ndarray, spread: np.ndarray, n: int) -> list[pa.Array]:
    """For each of n sets, LONGS columns of bits: whether each part of the hash domain has an odd number of elements. Each differing bit takes a differing element."""
    cell = (spread >> W.U(40)) & W.U(64 * LONGS - 1)
    words = np.zeros(n * LONGS, W.U)
    np.bitwise_xor.at(words, doc * LONGS + (cell >> W.U(6)).astype(np.int64), W.U(1) << (cell & W.U(63)))
    words = words.view(np.int64).reshape(n, LONGS)
    return [pa.array(np.ascontiguousarray(words[:, i])) for i in range(LONGS)]


def wide_parities(doc: np.ndarray, spread: np.ndarray, size: np.ndarray) -> pa.Array:
    """WIDE_BYTES bytes of parities more of the sets of WIDE_FROM elements or more; null for others."""
    large = size >= WIDE_FROM
    number = np.cumsum(large) - 1
    use = large[doc]
    bits, n = 8 * WIDE_BYTES, int(large.sum())
    cell = number[doc[use]] * bits + ((spread[use] >> W.U(16)) & W.U(bits - 1)).astype(np.int64)
    odd = np.packbits((np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8), bitorder="little").reshape(n, WIDE_BYTES)
    return pa.array([odd[i].tobytes() if x else None for i, x in zip(number.tolist(), large.tolist(), strict=True)], pa.binary())


def near_wide(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those pairs (a, b) that the sizes na and nb and the wide parities pa and pb allow; a pair with a null says nothing and stays."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                none = part.column("pa").is_null().to_numpy(zero_copy_only=False) | part.column("pb").is_null().to_numpy(zero_copy_only=False)
                at = np.flatnonzero(~none)
                x, y = (np.frombuffer(b"".join(part.column(c).take(pa.array(at)).to_pylist()), np.uint64).reshape(len(at), WIDE_BYTES // 8) for c in ("pa", "pb"))
                odd = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                n = (part.column("na").fill_null(0).to_numpy(zero_copy_only=False) + part.column("nb").fill_null(0).to_numpy(zero_copy_only=False))[at]
                ok = none
                ok[at] = odd * (100 + percent) <= n * (100 - percent)
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def picked(rows: DataFrame, keys: DataFrame, on: str = "key") -> DataFrame:
    """``rows`` whose ``on`` is among ``keys``, a written table: by a broadcast where the keys are few, else by a partitioned join."""
    keys = keys.select(on)
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_KEYS else keys, on, "left_semi")


def apart(a: str, b: str) -> Column:
    """How many parities of two rows differ, a bound of the distance from below."""
    return sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITY), F.lit(0))


def near(a: str, b: str, percent: int) -> Column:
    """Whether two rows with n, the set's size, and parities can be similar at all: both bound the distance from below."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart(a, b) * (100 + percent) <= (n + m) * (100 - percent))


def open_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (sig, key, ...) of the groups with more than one key. Groups are told by their least and greatest key, aggregated before the shuffle, so a hot group is no task's."""
    ends = rows.groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi")
    return picked(rows, cut(ends.select("sig")), "sig")


def distinct_groups(shared: DataFrame) -> DataFrame:
    """``shared`` with one sig of those that have the very same keys (by two 64-bit hashes of the set): alike members share many signatures, which say the same."""
    groups = shared.groupBy("sig").agg(F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(7))).alias("y"), F.count("*").alias("n"))
    return shared.join(groups.groupBy("x", "y", "n").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Rows (node, root) after more links (a, b): components of the old components, so the whole graph is not walked again."""
    if roots is None:
        return cut(components(links))
    ends = links
    for side in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}")), side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    step = components(ends.select("ra", "rb")).select(F.col("node").alias("root"), F.col("root").alias("new"))
    step = cut(step)
    old = roots.join(step, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    lone = step.join(roots.select(F.col("root")).distinct(), "root", "left_anti").select(F.col("root").alias("node"), F.col("new").alias("root"))
    return cut(old.union(lone))


def _unmerged(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (sig, key, root) of the groups that still hold several components."""
    held = shared.select("sig", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ends = held.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return cut(held.join(ends.select("sig"), "sig", "left_semi"))


def _heavy(held: DataFrame, slack: int) -> DataFrame:
    """``held`` of the groups whose members of different components make many pairs, counted by sizes of components."""
    sizes = held.groupBy("sig", "root").agg(F.count("*").alias("n")).groupBy("sig").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("within"))
    many = sizes.where(F.col("all") * F.col("all") - F.col("within") > 2 * slack * F.col("all")).select("sig")
    return cut(picked(held, cut(many), "sig"))


def _stars(held: DataFrame, heads: DataFrame, close: Column, turn: int) -> DataFrame:
    """Pairs (a, b) to verify: each key with the centre of most of its groups, if ``close`` allows it, and at most one pair for two components.

    A group's centre is its first key by one of ORDERS random orders, so that a key meets several centres of its surroundings, but not one for each group.
    """
    order = F.xxhash64("key", F.pmod(F.shiftright("sig", 7), F.lit(ORDERS)), F.lit(turn))
    centre = held.groupBy("sig").agg(F.min(F.struct(order.alias("o"), F.col("key").alias("a"), F.col("root").alias("ra"))).alias("c")).select("sig", "c.a", "c.ra")
    pairs = held.join(centre, "sig").where("root <> ra").groupBy("a", "ra", F.col("key").alias("b"), F.col("root").alias("rb")).agg(F.count("*").alias("n"))
    most = pairs.groupBy("b", "rb").agg(F.max(F.struct("n", F.xxhash64("a", F.lit(turn)).alias("o"), "a", "ra")).alias("c")).select("c.a", "c.ra", "b", "rb")
    one = most.join(heads.alias("x"), F.col("a") == F.col("x.key")).join(heads.alias("y"), F.col("b") == F.col("y.key")).where(close).select("a", "ra", "b", "rb")
    return one.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def _met(held: DataFrame, heads: DataFrame, close: Column, turn: int) -> DataFrame:
    """Pairs (a, b) to verify: each key outside its group's largest component with the nearest of about CENTRES centres of each of its FEW least groups, if ``close`` allows it, and at most one pair for two components.

    A family just around the threshold has few close ones for each key, which one centre hardly ever meets. Comparisons are CENTRES times the rows at most, about. Centres are told by their own hash, so they are the same in most groups.
    """
    sizes = held.groupBy("sig", "root").agg(F.count("*").alias("n")).groupBy("sig").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("m"))
    rows = held.join(heads, "key").join(sizes.select("sig", "size", F.col("m.root").alias("major")), "sig")
    drawn = F.shiftrightunsigned(F.xxhash64("key", F.lit(turn)), 33) * F.col("size") < CENTRES << 31
    few = held.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FEW).alias("sig")).select("key", F.explode("sig").alias("sig"))
    x, y = rows.where("root <> major").join(few, ["key", "sig"], "left_semi").alias("x"), rows.where(drawn).alias("y")
    met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & close)
    best = met.groupBy(F.col("x.key").alias("b"), F.col("x.root").alias("rb")).agg(F.min(F.struct(apart("x", "y").alias("odd"), F.col("y.key").alias("a"), F.col("y.root").alias("ra"))).alias("c")).select("c.*", "b", "rb")
    return best.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(F.struct("odd", "a", "b")).alias("p")).select("p.a", "p.b")


def _rest(held: DataFrame, heads: DataFrame, close: Column) -> DataFrame:
    """Pairs (a, b) of keys of different components that share a group and that ``close`` allows. Pairs within a group's largest component are not looked at. Each
    key carries its FEW least groups: a pair is made in the least that both carry and in no greater one, so alike keys are hardly ever made twice."""
    sizes = held.groupBy("sig", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("sig").agg(F.max(F.struct("n", "root")).alias("m")).select("sig", F.col("m.root").alias("major"))
    own = held.groupBy("key").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, FEW).alias("few"))  # of one key, so no more than its signatures
    rows = held.join(own.join(heads, "key"), "key").join(most, "sig")
    x, y = rows.where("root <> major").alias("x"), rows.alias("y")
    apart = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.major")) | (F.col("x.root") < F.col("y.root")))
    pair = F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")
    once = F.coalesce(F.array_min(F.array_intersect("x.few", "y.few")) >= F.col("x.sig"), F.lit(True))
    return x.join(y, apart & close & once).select(*pair).distinct()


def connect(shared: DataFrame, heads: DataFrame, close: Column, similar: Callable[[DataFrame], DataFrame], more: int = 0, slack: int = SLACK) -> DataFrame:
    """Rows (node, root) that connect what comparing all pairs of every group would connect.

    shared: rows (sig, key), a group for each sig. heads: one row (key, ...) for each key, on which ``close`` rules pairs x, y out cheaply. similar: keeps the similar ones of
    some pairs (a, b). First each key is compared with one centre of its groups, which merges nearly all that belongs together; rounds of many centres, or ``more`` of one at most, follow in groups that still hold more than ``slack`` open pairs a row; then the pairs
    across what is still apart, minus those that ``close`` rules out, are compared exactly. A pair that is connected already is not compared.
    """
    roots, stale = None, False
    held = every = shared.select("sig", "key", F.col("key").alias("root"))
    rounds = ROUNDS if more else 1
    for turn in range(rounds + (more or MET)):
        if turn >= rounds:
            held = _heavy(held, slack)
            if held.isEmpty():
                break
        found = cut(similar(cut((_stars if more or turn < rounds else _met)(held, heads, close, turn))))
        if found.isEmpty():
            if turn:
                break
            continue
        roots = merged(roots, found)
        if turn >= rounds and more and found.count() * YIELD < held.count():
            stale = True
            break  # the next rounds would cost more than the pairs that they spare the last join
        held = _unmerged(held, roots)
        every, stale = (held, False) if turn < rounds else (every, True)
    if stale:
        every = _unmerged(every, roots)
    rest = cut(_rest(every, heads, close))
    found = cut(similar(rest))
    if not found.isEmpty():
        roots = merged(roots, found)
    return roots if roots is not None else found.select(F.col("a").alias("node"), F.col("b").alias("root"))
