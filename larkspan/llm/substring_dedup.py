"""Operator 10, substring dedup over compressed FM-indexes.

A passage of SPAN words that two documents share has the same least K-word hash on both sides (its anchor). Anchors of two or more documents are brought
together with their contexts, the up to 2 * SPAN - K words that any such passage around the anchor can reach. Equal contexts are one. Where an anchor has many, they are cut
down to the runs of windows that several contexts have, of which equal ones are one again. Each shard of anchors gets an FM-index of these pieces, and the pieces are searched
backwards for the longest matches with documents of smaller ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import fm_index
from larkspan.llm import sieve as S
from larkspan.llm import words as W
from larkspan.llm.shared import cut, partitions, scope, tidy
from larkspan.llm.winnowing import _sliding_min

SPAN, K = 50, 20
SHARD_PIECES = 6_000  # pieces of a shard, on average
MANY = 64  # contexts of an anchor that are cut down before they are indexed: those of a passage in many surroundings become a few pieces


class Anchors:
    """Anchors of a slice of texts: word number, hash, and the bounds and hash of the context."""

    def __init__(self, x: W.Text, span: int, k: int):
        self.sums = x.sums()
        n, width = len(x.doc), span - k + 1
        at = np.arange(max(0, n - span + 1))
        at = at[x.doc[at] == x.doc[at + span - 1]]
        if not len(at):
            self.at, self.hash, self.first, self.last, self.context = (np.zeros(0, t) for t in (np.int64, W.U, np.int64, np.int64, W.U))
            return
        places = np.arange(n - k + 1)
        grams = W.spans_hash(self.sums, places, places + k, W.WORDS)
        flipped = np.full(len(grams) + width - 1, np.iinfo(np.uint64).max, W.U)  # complements of the windows' minima; places without a window never win
        flipped[width - 1 + at] = ~_sliding_min(grams, width)[at]
        most = ~_sliding_min(flipped, width)  # an anchor is the least of some window that holds it
        self.at = np.flatnonzero((most == grams) & W.covered(at, width, len(grams)))
        doc = x.doc[self.at]
        self.hash = grams[self.at]
        self.first = np.maximum(x.first[doc], self.at - (span - k))
        self.last = np.minimum(x.first[doc + 1], self.at + span)
        self.context = W.mix(W.spans_hash(self.sums, self.first, self.last, W.WORDS) + (self.at - self.first).astype(W.U))
        self.doc = doc


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _text_key(x: W.Text, sums: np.ndarray) -> np.ndarray:
    return W.spans_hash(sums, x.first[:-1], x.first[1:], W.WORDS)


def _places(frame: DataFrame, span: int, k: int) -> DataFrame:
    """Rows (anchor, ctx, id, tkey, first, last) of every text's anchors; tkey is a hash of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for x in W.texts(batch.column("text")):
                a = Anchors(x, span, k)
                if len(a.at):
                    yield pa.RecordBatch.from_arrays([_longs(a.hash), _longs(a.context), ids.take(pa.array(a.doc + x.row)), _longs(_text_key(x, a.sums)[a.doc]), *(pa.array((v - x.first[a.doc]).astype(np.int32)) for v in (a.first, a.last))], ["anchor", "ctx", "id", "tkey", "first", "last"])

    return frame.mapInArrow(tidy(run), "anchor long, ctx long, id long, tkey long, first int, last int")


def _context_words(frame: DataFrame, span: int, k: int, bits: np.ndarray) -> DataFrame:
    """Rows (ctx, id, words) of contexts whose (ctx, id) passes the sieve; words are hashes."""
    held = frame.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for x in W.texts(batch.column("text")):
                a = Anchors(x, span, k)
                if not len(a.at):
                    continue
                own = ids[a.doc + x.row].astype(np.int64)
                ok = S.passes(held.value, (a.context.view(np.int64) ^ (own << 20)).view(np.uint64))
                first, size = a.first[ok], (a.last - a.first)[ok]
                if not len(first):
                    continue
                offset = np.concatenate([[0], np.cumsum(size)])
                flat = np.repeat(first - offset[:-1], size) + np.arange(offset[-1])
                yield pa.RecordBatch.from_arrays([_longs(a.context[ok]), _longs(own[ok]), pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), _longs(x.hash[flat]))], ["ctx", "id", "words"])

    return frame.mapInArrow(tidy(run), "ctx long, id long, words array<long>")


def _search(span: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        """Of each piece the intervals that a document of a smaller id has too."""
        shard = shard.drop_duplicates("piece").sort_values(["owner", "piece"]).reset_index(drop=True)
        sizes = shard.words.map(len).to_numpy(np.int64)
        symbols = np.zeros(int(sizes.sum() + len(sizes)), np.int64)
        begin = np.cumsum(sizes + 1) - sizes - 1
        real = np.ones(len(symbols), bool)
        real[begin + sizes] = False
        known, ids = np.unique(np.concatenate(shard.words.to_numpy()), return_inverse=True)
        symbols[real] = ids + 1
        _, owner = np.unique(shard.owner.to_numpy(np.int64), return_inverse=True)
        index = fm_index.FMIndex(symbols, np.repeat(owner, sizes + 1), len(known) + 1)
        at, lo, hi = fm_index.earlier_matches(index, symbols, begin, begin + sizes, owner.astype(np.int64), span)
        return pd.DataFrame({"piece": shard.piece.to_numpy(np.int64)[at], "lo": (lo - begin[at]).astype(np.int32), "hi": (hi - begin[at]).astype(np.int32)})

    return run


def _windows(lists: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window of the rows: row, first word, hash; and the words of all rows with each row's first."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.maximum(size - span + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    lo = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.cumsum(size) - size
    at = begin[row] + lo
    return row, lo, W.spans_hash(W.prefix(flat, W.WORDS), at, at + span, W.WORDS), flat, begin


def _cut_down(contexts: DataFrame, span: int) -> DataFrame:
    """Rows (anchor, ctx, owner, off, piece, words): the runs of windows of each context that some other context has too, or may have by the sieve, as pieces with their place."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, key, _, _ = _windows(batch.column("words"), span)
            yield pa.RecordBatch.from_arrays([batch.column("ctx").take(pa.array(row)), _longs(key)], ["ctx", "window"])

    ends = contexts.select("ctx", "words").mapInArrow(tidy(told), "ctx long, window long").groupBy("window").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b"))
    held = contexts.sparkSession.sparkContext.broadcast(S.build(cut(ends.where("a <> b").select("window")), "window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, lo, key, flat, begin = _windows(batch.column("words"), span)
            ok = S.passes(held.value, key)
            row, lo = row[ok], lo[ok]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (lo[1:] != lo[:-1] + 1)
            first = np.flatnonzero(new)
            own, off, size = row[first], lo[first], np.diff(np.append(first, len(row))) + span - 1
            offset = np.concatenate([[0], np.cumsum(size)])
            words = flat[np.repeat(begin[own] + off - offset[:-1], size) + np.arange(offset[-1])]
            piece = W.spans_hash(W.prefix(words, W.WORDS), offset[:-1], offset[1:], W.WORDS)
            take = pa.array(own)
            lists = pa.ListArray.from_arrays(pa.array(offset.astype(np.int32)), _longs(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("anchor", "ctx", "owner")), pa.array(off.astype(np.int32)), _longs(piece), lists], ["anchor", "ctx", "owner", "off", "piece", "words"])

    return contexts.select("anchor", "ctx", "owner", "words").mapInArrow(tidy(run), "anchor long, ctx long, owner long, off int, piece long, words array<long>")


def repeats(docs: DataFrame, id_col: str, text_col: str, span: int = SPAN, k: int = K) -> DataFrame:
    """Rows (id, tkey, lo, hi): word intervals covered by windows of ``span`` words that also start in a document of a smaller id."""
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    every = cut(_places(frame, span, k))
    shared = every.groupBy("anchor").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    shared = cut(shared.where("first_id < last_id").select("anchor", "first_id", (F.col("c0") != F.col("c1")).alias("several")))
    places = cut(every.join(shared, "anchor"))
    owners = cut(places.groupBy("anchor", "ctx", "several", "first_id").agg(F.min("id").alias("owner")))
    several = owners.where("several")
    keys = several.select(F.col("ctx").bitwiseXOR(F.shiftleft("owner", 20)).alias("k"))
    words = cut(_context_words(frame, span, k, S.build(keys, "k")).withColumnRenamed("id", "owner"))  # a text's contexts overlap, so they are small on disk as they come
    many = cut(several.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("anchor"))
    several = several.select("anchor", "ctx", "owner")
    hot = several.join(many, "anchor", "left_semi")
    pieces = cut(_cut_down(cut(hot.join(words, ["ctx", "owner"]).dropDuplicates(["anchor", "ctx"])), span))
    # of equal pieces of an anchor the one with the least owner is indexed; the others are repeats of it
    least = cut(pieces.groupBy("anchor", "piece").agg(F.min(F.struct("owner", "ctx", "off")).alias("m")).select("anchor", "piece", F.col("m.owner").alias("least"), F.col("m.ctx").alias("c"), F.col("m.off").alias("o")))
    told = pieces.join(least, ["anchor", "piece"])
    few = several.join(many, "anchor", "left_anti").join(words, ["ctx", "owner"]).select("anchor", F.col("ctx").alias("piece"), "owner", "words")
    indexed = few.union(told.where("ctx = c and off = o").select("anchor", "piece", "owner", "words"))
    shards = max(1, several.count() // SHARD_PIECES)
    found = indexed.withColumn("shard", F.pmod("anchor", F.lit(shards))).repartition(min(shards, 16 * partitions(docs.sparkSession)), "shard")
    found = cut(found.groupBy("shard").applyInPandas(_search(span), "piece long, lo int, hi int")).distinct()
    short = told.select("ctx", "off", "piece", "owner", "least", F.size("words").alias("n"))
    own = short.where("owner = least").join(found, "piece").select("ctx", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    copied = short.where("owner > least").select("ctx", F.col("off").alias("lo"), (F.col("off") + F.col("n")).alias("hi"))
    matched = cut(found.select(F.col("piece").alias("ctx"), "lo", "hi").union(own).union(copied).distinct())
    place = places.join(owners.select("anchor", "ctx", "owner"), ["anchor", "ctx"])
    whole = place.where("id > owner").select("id", "tkey", F.col("first").alias("lo"), F.col("last").alias("hi"))
    part = place.where("id = owner and several and owner > first_id").join(matched, "ctx").select("id", "tkey", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    return whole.where(F.col("hi") - F.col("lo") >= span).union(part)


def _kept(text: str, spans: list | None) -> tuple[int, int, bytes]:
    words = text.encode().split()
    n = len(words)
    if spans is not None and len(spans):
        gone = np.zeros(n + 1, np.int64)
        lo, hi = (np.array([s[f] for s in spans], np.int64) for f in ("lo", "hi"))
        gone = np.cumsum(np.bincount(lo, minlength=n + 1) - np.bincount(hi, minlength=n + 1))[:n] > 0
        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return n, n - len(words), b" ".join(words)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, text: bool = False) -> DataFrame:
    """One row for each input row: id_col, n_words, n_removed, kept_sha256 (and kept_text if ``text``).

    A word (run of non-blanks) goes if some window of ``span`` words over it also starts in a document of a smaller id. All windows are judged on the input. A null
    text has no words; a text shorter than a window keeps all of its words, and so does a row with a null id, which is also no one's
    predecessor. Rows with equal ids and equal texts get equal results; rows with equal ids and different texts are kept apart. An empty table gives an empty one.
    Texts of any length are searched whole.
    """
    with scope(docs.sparkSession) as kept:
        found = kept(repeats(docs, id_col, text_col, span, k).groupBy("id", "tkey").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    held = docs.sparkSession.sparkContext.broadcast(S.build(found, "tkey"))
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(frame.dtypes)["id"]
    more = ", kept string" if text else ""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What has no interval by the sieve is done here; of the rest the text goes on."""
        for batch in batches:
            for x in W.texts(batch.column("text")):
                own = batch.slice(x.row, len(x))
                key = _text_key(x, x.sums())
                maybe = S.passes(held.value, key)
                raw = own.column("text").fill_null("").to_pylist()
                kept = [None if m else _kept(t, None)[2] for t, m in zip(raw, maybe.tolist(), strict=True)]
                cols = [own.column("id"), _longs(key), pa.array(x.n_words().astype(np.int64)), pa.array([None if b is None else hashlib.sha256(b).hexdigest() for b in kept], pa.string()), pa.array([t if m else None for t, m in zip(raw, maybe.tolist(), strict=True)], pa.string())]
                names = ["id", "tkey", "n_words", "sha", "text"]
                if text:
                    cols, names = [*cols, pa.array([None if b is None else b.decode() for b in kept], pa.string())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["text", "spans"]).to_pylist()
            out = [_kept(r["text"] or "", r["spans"]) for r in rows]
            cols = [batch.column("id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string())]
            names = ["id", "n_words", "n_removed", "sha"]
            if text:
                cols, names = [*cols, pa.array([o[2].decode() for o in out], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    told = cut(frame.mapInArrow(tidy(first), f"id {kind}, tkey long, n_words long, sha string, text string{more}"))
    done = told.where("text is null").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), "sha", *(["kept"] if text else []))
    rest = told.where("text is not null").select("id", "tkey", "text").join(found.withColumn("id", F.col("id").cast(kind)), ["id", "tkey"], "left").select("id", "text", "spans")
    rest = rest.mapInArrow(tidy(last), f"id {kind}, n_words long, n_removed long, sha string{more}")
    return done.union(rest).select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("sha").alias("kept_sha256"), *([F.col("kept").alias("kept_text")] if text else []))
