"""Operator 9, an n-gram Jaccard join by PartEnum signatures.

A text is the set of its distinct word n-grams. Size bands overlap so that two sets of Jaccard similarity p or more are both in one of them, and there they differ in at
most k elements, k set by the band's largest size. The hash domain is cut into k // 2 + 1 + slack partitions, so that in some of them the sets differ in one element at
most, and each partition into PARTS parts: all subsets of PARTS - 1 parts are enumerated, and the projection on each is a signature. The sets agree on one subset at least
and so share its signature. Sharing sets are then compared exactly.

Subsets of no or few elements are shared by sets that have nothing else in common. All subsets have one order, by elements first; each set leaves out the least ones, as long as they
are of no more partitions than it can spare: those beyond the d // 2 + 1 that its own size asks for, d being how far a similar set of the band can be from it. Of two similar sets, one
leaves out all that the other does; it agrees with the other in more partitions than it spares, and so on a subset that both sign.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sieve as S
from larkspan.llm import words as W
from larkspan.llm.linking import PARITY, connect, distinct_groups, near, near_wide, parities, picked, wide_parities
from larkspan.llm.shared import cut, scope, tidy

PARTS = 3  # of a partition; a signature leaves one out
SLACK, SLACK_SHARE, SLACK_FROM = 2, 40, 8  # 2 + k // 40 partitions more than needed where k is 8 or more, so that hardly a set has to sign subsets of few elements
SLICES = 2  # of the signatures, one after the other: shuffle files of one at a time are on disk, for one reading of the texts more
ORDER_BITS = 16  # of a signature, to order subsets with equally many elements


def bands(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of each band, up to ``most``: similar sets, whose sizes are within a ratio, are both in some band."""
    low, high = [1], []
    while low[-1] <= most:
        high.append(max(low[-1] * 100**3 // percent**3, low[-1]))
        low.append(max(low[-1] + 1, -(-(high[-1] + 1) * percent // 100)))  # the first size that has partners beyond the band
    return np.array(low[:-1] or [1], np.int64), np.array(high or [1], np.int64)


def distance(percent: int, size: np.ndarray) -> np.ndarray:
    """Most elements in which two similar sets of up to ``size`` elements each can differ."""
    return (100 - percent) * 2 * size // (100 + percent)


def farthest(percent: int, size: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Most elements in which a set of each size can differ from a similar one of up to ``high`` elements."""
    return (100 - percent) * (size + np.minimum(high, size * 100 // percent)) // (100 + percent)


def _least_kept(order: np.ndarray, first: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """For each set, the greatest bound such that no more than ``spare`` of its partitions, rows first[i] to first[i + 1], have an order below it; 0 for a set without partitions."""
    n = np.diff(first)
    by_set = order[np.lexsort((order, np.repeat(np.arange(len(n)), n)))]
    out = np.zeros(len(n), W.U)
    some = n > 0
    out[some] = by_set[first[:-1][some] + spare[some]]
    return out


class Sets:
    """The distinct n-grams of each text of a slice: element hashes, sorted within each text."""

    def __init__(self, x: W.Text, ngram: int):
        sums, n = x.sums(), x.n_words()
        at, h = x.grams(ngram, sums)
        short = np.flatnonzero((n > 0) & (n < ngram))
        h = np.concatenate([h, W.spans_hash(sums, x.first[short], x.first[short + 1], W.WORDS)])
        doc = np.concatenate([x.doc[at], short])
        order = np.argsort(h)
        narrow = np.uint16 if len(x) < 1 << 16 else np.int64  # sorted by radix
        order = order[np.argsort(doc[order].astype(narrow), kind="stable")]
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.hash, self.doc = h[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(x) + 1))
        self.size = np.diff(self.first)
        self.spread = W.mix(self.hash ^ W.U(0xA5A5A5A55A5A5A5A))
        self.key = W.mix(_sums(self.doc, self.spread, len(x)) + self.size.astype(W.U))

    def only(self, docs: np.ndarray) -> Sets:
        """The chosen sets, in their order, numbered anew."""
        number = np.full(len(self.size), -1)
        number[docs] = np.arange(len(docs))
        use = number[self.doc] >= 0
        out = object.__new__(Sets)
        out.hash, out.doc, out.spread = self.hash[use], number[self.doc[use]], self.spread[use]
        out.size, out.key = self.size[docs], self.key[docs]
        out.first = np.concatenate([[0], np.cumsum(out.size)])
        return out

    def signatures(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Set number and signature, of each set in each band that holds its size; nothing for an empty set."""
        low, high = bands(percent, int(self.size.max(initial=1)))
        last = np.searchsorted(low, self.size, "right") - 1
        found = [(np.zeros(0, np.int64), np.zeros(0, W.U))]
        for back in range(len(low)):
            band = np.maximum(last - back, 0)
            inside = (self.size > 0) & (last >= back) & (self.size <= high[band])
            if not inside.any():
                break
            k = distance(percent, high[band])
            slack = np.where(k >= SLACK_FROM, SLACK + k // SLACK_SHARE, 0)
            n = np.where(inside & (k > 0), k // 2 + 1 + slack, 0)  # partitions; within k = 0 only equal sets are similar
            part0 = np.concatenate([[0], np.cumsum(n)])
            use = n[self.doc] > 0
            d = self.doc[use]
            place = ((self.hash[use] >> W.U(32)) * (PARTS * n[d]).astype(W.U)) >> W.U(32)
            cell = PARTS * part0[d] + place.astype(np.int64)
            part = _sums(cell, self.spread[use], PARTS * part0[-1]).reshape(-1, PARTS)
            count = np.bincount(cell, minlength=PARTS * part0[-1]).reshape(-1, PARTS)
            owner = np.repeat(np.arange(len(n)), n)
            # of each partition, the subsets that leave one part out
            total = part.sum(axis=1, keepdims=True, dtype=W.U) - part
            tag = band[owner].astype(W.U) * W.U(1 << 40) + (np.arange(len(owner)) - part0[owner]).astype(W.U) * W.U(PARTS)
            sig = W.mix(total + W.mix(tag[:, None] + np.arange(PARTS, dtype=W.U)))
            order = ((count.sum(axis=1, keepdims=True) - count).astype(W.U) << W.U(ORDER_BITS)) | (sig >> W.U(64 - ORDER_BITS))
            spare = n - 1 - farthest(percent, self.size, high[band]) // 2
            emit = order >= _least_kept(order.min(axis=1), part0, spare)[owner][:, None]
            found.append((np.repeat(owner, PARTS).reshape(-1, PARTS)[emit], sig[emit]))
        return tuple(np.concatenate(p) for p in zip(*found, strict=True))


def _sums(cell: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of 64-bit values in each cell, modulo 2**64; the halves are exact as doubles."""
    low = np.bincount(cell, (values & W.U(0xFFFFFFFF)).astype(np.float64), n).astype(W.U)
    high = np.bincount(cell, (values >> W.U(32)).astype(np.float64), n).astype(W.U)
    return low + (high << W.U(32))


def _sets(column: pa.Array, ngram: int) -> Iterator[tuple[W.Text, Sets]]:
    for x in W.texts(column, W.BLANK, lower=True):
        yield x, Sets(x, ngram)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def classes(docs: DataFrame, ngram: int) -> DataFrame:
    """Each row (its columns but text) with n, the set's size, and key, its hash; equal sets have equal keys."""
    others, kinds = [c for c in docs.columns if c != "text"], dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, sets in _sets(batch.column("text"), ngram):
                own = batch.slice(x.row, len(x))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in others), _longs(sets.size), _longs(sets.key)], [*others, "n", "key"])

    return docs.mapInArrow(tidy(run), ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "n long, key long"]))


def _fresh(sets: Sets) -> np.ndarray:
    """Of the sets with elements, one for each key of the slice."""
    some = np.flatnonzero(sets.size > 0)
    return np.sort(some[np.unique(sets.key[some], return_index=True)[1]])


def _signed(texts: DataFrame, ngram: int, percent: int, turn: int) -> DataFrame:
    """Rows (sig, key) of the signatures whose turn it is, of SLICES; equal sets of one batch sign once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), ngram):
                own = sets.only(_fresh(sets))
                doc, sig = own.signatures(percent)
                use = sig % W.U(SLICES) == W.U(turn)
                doc, sig = doc[use], sig[use]
                for at in range(0, len(sig), 1 << 18):
                    yield pa.RecordBatch.from_arrays([_longs(sig[at : at + (1 << 18)]), _longs(own.key[doc[at : at + (1 << 18)]])], ["sig", "key"])

    return texts.mapInArrow(tidy(run), "sig long, key long")


def _several(texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Rows (sig) of the signatures of several keys."""
    found = []
    for turn in range(SLICES):
        ends = _signed(texts, ngram, percent, turn).groupBy("sig").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
        found.append(cut(ends.where("lo <> hi").select("sig")))
    return reduce(DataFrame.union, found)


def _shared(texts: DataFrame, ngram: int, percent: int, several: DataFrame) -> DataFrame:
    """Rows (sig, key) of the signatures ``several``; equal sets of several slices come several times."""
    held = texts.sparkSession.sparkContext.broadcast(S.build(several, "sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), ngram):
                own = sets.only(_fresh(sets))
                doc, sig = own.signatures(percent)
                ok = S.passes(held.value, sig)
                yield pa.RecordBatch.from_arrays([_longs(sig[ok]), _longs(own.key[doc[ok]])], ["sig", "key"])

    return texts.mapInArrow(tidy(run), "sig long, key long").join(several, "sig", "left_semi")


def _members(texts: DataFrame, ngram: int, wanted: DataFrame) -> DataFrame:
    """Rows (key, n, parities, wide, elems) of the wanted sets, one for each key."""
    held = texts.sparkSession.sparkContext.broadcast(S.build(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch.column("text"), ngram):
                docs = _fresh(sets)
                docs = docs[S.passes(held.value, sets.key[docs])]
                if len(docs):
                    own = sets.only(docs)
                    elems = pa.ListArray.from_arrays(pa.array(own.first.astype(np.int32)), _longs(own.hash))
                    yield pa.RecordBatch.from_arrays([_longs(own.key), _longs(own.size), *parities(own.doc, own.spread, len(docs)), wide_parities(own.doc, own.spread, own.size), elems], ["key", "n", *PARITY, "wide", "elems"])

    kinds = ", ".join(["key long, n long", *(f"{p} long" for p in PARITY), "wide binary, elems array<long>"])
    return texts.mapInArrow(tidy(run), kinds).dropDuplicates(["key"]).join(wanted, "key", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets are similar. Wide parities, a small part of a large set's bytes, rule pairs out before elements are moved."""
    side = lambda rows, s: rows.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("wide").alias(f"p{s}"), F.col("elems").alias(f"e{s}"))
    keys = lambda p: cut(p.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    large = picked(sets.where("wide is not null"), keys(pairs))
    told = pairs.join(side(large, "b").drop("eb"), "b", "left").join(side(large, "a").drop("ea"), "a", "left").select("a", "b", "na", "nb", "pa", "pb")
    pairs = cut(told.mapInArrow(tidy(near_wide(percent)), "a long, b long"))
    own = picked(sets, keys(pairs))
    n, m = F.size("ea"), F.size("eb")
    shared = F.size(F.array_intersect("ea", "eb")).cast("long")
    return pairs.join(side(own, "b").select("b", "eb"), "b").join(side(own, "a").select("a", "ea"), "a").where(shared * 100 >= percent * (n + m - shared)).select("a", "b").distinct()


def roots(texts: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Rows (node, root) of the keys of sets that the similarity graph links to others.

    A first pass finds the signatures of several keys, by aggregation, a second one the keys of these, and a third one brings those sets, once for each key.
    """
    with scope(texts.sparkSession) as kept:
        several = _several(texts, ngram, percent)
        with scope(texts.sparkSession) as own:
            shared = own(distinct_groups(cut(_shared(texts, ngram, percent, several).distinct())))
        sets = cut(_members(texts, ngram, cut(shared.select("key").distinct())))
        return kept(connect(shared, sets.select("key", "n", *PARITY), near("x", "y", percent), lambda pairs: _similar(pairs, sets, percent)))


def _told(docs: DataFrame, id_col: str, text_col: str, ngram: int, percent: int, keep: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """Each input row (carried columns as __c0, __c1, ...) with n, __hash of the text and, unless its set is empty, root, the component's least key, and head,
    the component's least place; and the carried columns' names. A place is (null id or not, id, hash), so null ids come last."""
    carried = list(dict.fromkeys((id_col, *keep)))
    frame = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)], F.xxhash64(F.col(f"`{text_col}`")).alias("__hash"), F.col(f"`{text_col}`").alias("text"))
    base = cut(classes(frame, ngram))
    root = roots(frame.select("text"), ngram, percent).withColumnRenamed("node", "key")
    least = base.where("n > 0").groupBy("key").agg(F.min(_place()).alias("first")).join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = least.groupBy("root").agg(F.min("first").alias("head"))
    return base.join(least.join(heads, "root").select("key", "root", "head"), "key", "left"), carried


def _place() -> Column:
    return F.struct(F.isnull("__c0").alias("none"), F.col("__c0").alias("id"), F.col("__hash").alias("hash"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: id_col, n_shingles, component_id (the least id reachable by links, its own included), columns of ``keep``.

    Two texts link when 100 * |intersection| >= percent * |union| of their sets of distinct word n-grams (words: runs of non-blanks, A-Z in lower case; a
    text of fewer words than ``ngram`` has its whole sequence as one). A null or empty text, or one of blanks, has an empty set and links with nothing, so its component is
    its own id. Equal sets are one class, compared once; rows with equal ids and different texts are different texts. Null ids are
    passed over for component_id unless a component has no other. An empty table gives an empty one. Hash sets stand for the texts' sets (64 bits).
    """
    out, carried = _told(docs, id_col, text_col, ngram, percent, keep)
    return out.select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)], F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head.id")).otherwise(F.col("__c0")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with their own columns: of each component the first by (id, text hash), null ids last, and every row whose set is empty."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    with scope(docs.sparkSession) as kept:  # what is left behind are places, no texts
        told, _ = _told(rows, names[id_col], names[text_col], ngram, percent, ())
        places = told.where("n > 0").groupBy("__c0", "__hash").agg(F.first(_place().eqNullSafe(F.col("head"))).alias("__stays"), F.count("*").alias("rows"))
        open_places = kept(places.where("not __stays or rows > 1").select("__c0", "__hash", "__stays"))
    sure, rest = S.apart(rows.withColumn("__hash", F.xxhash64(names[text_col])), open_places, "__hash")
    found = rest.join(open_places.withColumnRenamed("__hash", "__h"), F.col(names[id_col]).eqNullSafe(F.col("__c0")) & (F.col("__hash") == F.col("__h")), "left").where("__stays is null or __stays")
    # rows of one place are equal in id and text: one of them stays
    one = found.withColumn("__row", F.when(F.col("__stays"), F.lit(-1)).otherwise(F.monotonically_increasing_id())).dropDuplicates([names[id_col], "__hash", "__row"])
    return sure.select(*names.values()).union(one.select(*names.values())).toDF(*docs.columns)
