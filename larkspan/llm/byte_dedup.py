"""Operator 12, exact substring dedup by a suffix sort whose comparisons are of hashes.

Of the K-byte hashes in each window of SPAN bytes the smallest, leftmost one is the window's anchor, so equal windows have equal anchors at equal places. The windows of one anchor make a context, a run
of bytes. Contexts are counted by hash before anything is sorted: all windows of one that is found twice are repeated. Where an anchor has different contexts, one of each goes to a shard of
anchors, and the suffixes that begin its windows are sorted; neighbours that agree in SPAN bytes are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sieve as S
from larkspan.llm import suffix_sort
from larkspan.llm import words as W
from larkspan.llm.shared import cut, partitions, scope, small_batches, tidy
from larkspan.llm.winnowing import _sliding_min

SPAN, K = 200, 64
SHARD_CONTEXTS = 3_000  # of a shard, on average
MANY = 64  # contexts of an anchor that are cut down to what others have too, before they are sorted
SPLIT = 32  # and are split at distances from their anchor, so that a frequent anchor is several shards' work


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _chunks(data: np.ndarray, offset: np.ndarray, span: int, most: int = W.SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts, or of a part of a long one, with their bounds, the row of each, and where it begins in its text; parts share span - 1 bytes, so each window is in one of them."""
    for lo, hi in W.cuts(offset, most):
        if hi > lo + 1 or offset[hi] - offset[lo] <= 2 * most:
            yield data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
            continue
        for at in range(0, int(offset[hi] - offset[lo]) - span + 1, most):
            part = data[offset[lo] + at : min(offset[hi], offset[lo] + at + most + span - 1)]
            yield part, np.array([0, len(part)]), np.array([lo]), np.array([at])


class Contexts:
    """Contexts of some texts: first window (place), number of windows, the anchor's distance from the first window and its hash, the context's hash, and the text's number."""

    def __init__(self, data: np.ndarray, offset: np.ndarray, span: int, k: int, hashed: bool = True):
        n, width = len(data), span - k + 1
        size = np.diff(offset)
        if n < span or not (size >= span).any():
            self.at = self.n = self.back = self.text = np.zeros(0, np.int64)
            self.anchor = self.context = np.zeros(0, W.U)
            return
        sums = W.prefix(data.astype(W.U) + W.U(1), W.BYTES)
        places = np.arange(n - k + 1)
        grams = W.spans_hash(sums, places, places + k, W.BYTES)
        least = _sliding_min(grams, width)
        step = np.zeros(n + 1, np.int64)
        long = np.flatnonzero(size >= span)
        np.add.at(step, offset[:-1][long], 1)
        np.add.at(step, offset[1:][long] - span + 1, -1)
        valid = np.cumsum(step)[: n - span + 1] > 0
        new = np.ones(len(least), bool)  # an anchor's windows end where the minimum changes or the anchor itself is passed
        new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | ~valid[:-1]
        self.at = np.flatnonzero(valid & new)
        breaks = np.append(np.flatnonzero(new | ~valid), len(least))
        end = breaks[np.searchsorted(breaks, self.at, "right")]
        self.n = end - self.at
        self.anchor = least[self.at]
        self.text = np.searchsorted(offset, self.at, "right") - 1
        if not hashed:
            return
        self.context = W.spans_hash(sums, self.at, end - 1 + span, W.BYTES)
        found, reach = np.empty(len(end), np.int64), np.arange(width)
        for i in range(0, len(end), 4096):
            last = end[i : i + 4096] - 1
            found[i : i + 4096] = last + grams[last[:, None] + reach].argmin(1)
        self.back = found - self.at


def _anchors(frame: DataFrame, span: int, k: int) -> DataFrame:
    """The anchor of each context of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offset, _, _ in _chunks(*W.buffers(batch.column("text")), span):
                yield pa.RecordBatch.from_arrays([_longs(Contexts(data, offset, span, k, False).anchor)], ["anchor"])

    return frame.select("text").mapInArrow(tidy(run), "anchor long")


def _places(frame: DataFrame, span: int, k: int, bits: np.ndarray) -> DataFrame:
    """Rows (anchor, ctx, d, t, lo, n, back) of the contexts whose anchor passes the sieve."""
    held = frame.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offset, row, begin in _chunks(*W.buffers(batch.column("text")), span):
                c = Contexts(data, offset, span, k)
                ok = np.flatnonzero(S.passes(held.value, c.anchor)) if len(c.at) else c.at
                if len(ok):
                    text = c.text[ok]
                    own = pa.array(row[text])
                    ints = (c.at[ok] - offset[text] + begin[text], c.n[ok], c.back[ok])
                    yield pa.RecordBatch.from_arrays([_longs(c.anchor[ok]), _longs(c.context[ok]), batch.column("d").take(own), batch.column("t").take(own), *(pa.array(v.astype(np.int32)) for v in ints)], ["anchor", "ctx", "d", "t", "lo", "n", "back"])

    return frame.select("d", "t", "text").mapInArrow(tidy(run), "anchor long, ctx long, d long, t long, lo int, n int, back int")


def _bytes(texts: DataFrame, span: int) -> DataFrame:
    """Rows (anchor, piece, many, twice, back, n, bytes) of the contexts that each text has in its list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            flat, row = lists.flatten(), np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            data, offset = W.buffers(batch.column("text"))
            n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
            at = offset[row] + flat.field("lo").to_numpy(zero_copy_only=False)
            for i in range(0, len(row), 8192):
                size = n[i : i + 8192] - 1 + span
                to = np.concatenate([[0], np.cumsum(size)])
                raw = data[np.repeat(at[i : i + 8192] - to[:-1], size) + np.arange(to[-1])]
                cells = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)])
                part = flat.slice(i, 8192)
                yield pa.RecordBatch.from_arrays([part.field("anchor"), part.field("ctx"), part.field("many"), part.field("twice"), part.field("back"), part.field("n"), cells], ["anchor", "piece", "many", "twice", "back", "n", "bytes"])

    return texts.mapInArrow(tidy(run), "anchor long, piece long, many boolean, twice boolean, back int, n int, bytes binary")


def _window_hashes(cells: pa.Array, n: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the pieces: its row, place in the piece and hash; and all bytes, their prefix sums and where each piece begins."""
    data, offset = W.buffers(cells)
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    sums = W.prefix(data.astype(W.U) + W.U(1), W.BYTES)
    begin = offset[row] + at
    return row, at, W.spans_hash(sums, begin, begin + span, W.BYTES), data, sums, offset


def _parts(cells: pa.Array, most: int = 4096) -> Iterator[tuple[int, int]]:
    for lo in range(0, len(cells), most):
        yield lo, min(len(cells), lo + most)


def _cut_down(pieces: DataFrame, span: int) -> DataFrame:
    """Of contexts, rows (anchor, ctx, off, piece, twice, back, n, bytes): runs of windows that by the sieve some other context of the anchor may have too, split where the distance from the anchor is a multiple of SPLIT."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _parts(batch.column("bytes")):
                part = batch.slice(lo, hi - lo)
                row, _, key, *_ = _window_hashes(part.column("bytes"), part.column("n").to_numpy(zero_copy_only=False), span)
                yield pa.RecordBatch.from_arrays([part.column("piece").take(pa.array(row)), _longs(key)], ["ctx", "window"])

    ends = pieces.select("piece", "n", "bytes").mapInArrow(tidy(told), "ctx long, window long").groupBy("window").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b"))
    held = pieces.sparkSession.sparkContext.broadcast(S.build(cut(ends.where("a <> b").select("window")), "window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _parts(batch.column("bytes")):
                part = batch.slice(lo, hi - lo)
                row, at, key, data, sums, offset = _window_hashes(part.column("bytes"), part.column("n").to_numpy(zero_copy_only=False), span)
                back = part.column("back").to_numpy(zero_copy_only=False)[row] - at
                ok = S.passes(held.value, key)
                row, at, back = row[ok], at[ok], back[ok]
                if not len(row):
                    continue
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (back[1:] // SPLIT != back[:-1] // SPLIT)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(row)))
                begin, size = offset[row[first]] + at[first], n - 1 + span
                to = np.concatenate([[0], np.cumsum(size)])
                raw = data[np.repeat(begin - to[:-1], size) + np.arange(to[-1])]
                cells = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(raw)])
                own = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [part.column("anchor").take(own), part.column("piece").take(own), pa.array(at[first].astype(np.int32)), _longs(W.spans_hash(sums, begin, begin + size, W.BYTES)), part.column("twice").take(own), pa.array(back[first].astype(np.int32)), pa.array(n.astype(np.int32)), cells],
                    ["anchor", "ctx", "off", "piece", "twice", "back", "n", "bytes"],
                )

    return pieces.select("anchor", "piece", "twice", "back", "n", "bytes").mapInArrow(tidy(run), "anchor long, ctx long, off int, piece long, twice boolean, back int, n int, bytes binary")


def _sort(span: int):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        """Of each piece that isn't known to be repeated as a whole, the intervals of bytes covered by windows that another piece of its anchor has too."""
        shard = shard.drop_duplicates(["anchor", "piece"])
        size = shard.bytes.map(len).to_numpy(np.int64)
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(shard.bytes), np.uint8)
        n, back = shard.n.to_numpy(np.int64), shard.back.to_numpy(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        _, anchor = np.unique(shard.anchor.to_numpy(np.int64), return_inverse=True)
        again = suffix_sort.repeated_suffixes(suffix_sort.HashedText(data, span), begin[row] + at, anchor[row] * span + back[row] - at)
        again &= ~shard.twice.to_numpy(bool)[row]
        row, at = row[again], at[again]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first, len(row))[1:] - 1
        return pd.DataFrame({"anchor": shard.anchor.to_numpy(np.int64)[row[first]], "piece": shard.piece.to_numpy(np.int64)[row[first]], "lo": at[first].astype(np.int32), "hi": (at[last] + span).astype(np.int32)})

    return run


def _sorted(pieces: DataFrame, split: bool, span: int) -> DataFrame:
    """Rows (anchor, piece, lo, hi): repeated intervals of the pieces that aren't repeated as a whole; shards are of whole anchors, or of whole distances from an anchor."""
    pieces = cut(pieces)
    shards = max(1, pieces.count() // SHARD_CONTEXTS)
    key = [F.col("anchor"), F.floor((F.col("back")) / SPLIT)] if split else [F.col("anchor")]
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards))).repartition(min(shards, 16 * partitions(pieces.sparkSession)), "shard")
    return cut(dealt.groupBy("shard").applyInPandas(_sort(span), "anchor long, piece long, lo int, hi int"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and (d, t), hashes of both: rows that agree in the text, and so in their result, may share them."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`")).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))


def repeats(frame: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Rows (d, t, lo, hi): byte intervals covered by windows of ``span`` bytes that also begin elsewhere. frame: rows (d, t, text)."""
    frame = frame.where(F.octet_length("text") >= span)
    bits = S.build(cut(_anchors(frame, span, k).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")), "anchor")
    places = cut(_places(frame, span, k, bits))
    classes = cut(places.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), F.min(F.struct("d", "t", "lo", "n", "back")).alias("r")))
    several = classes.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    reps = cut(classes.join(several, "anchor").select("anchor", "ctx", (F.col("m") > MANY).alias("many"), (F.col("c") > 1).alias("twice"), "r.*"))
    wanted = reps.groupBy("d", "t").agg(F.collect_list(F.struct("anchor", "ctx", "many", "twice", "lo", "n", "back")).alias("wanted"))
    pieces = cut(_bytes(frame.select("d", "t", "text").join(wanted, ["d", "t"]).select("text", "wanted"), span))
    few = _sorted(pieces.where("not many").drop("many"), False, span)
    hot = cut(_cut_down(pieces.where("many").drop("many").dropDuplicates(["anchor", "piece"]), span))
    kinds = hot.groupBy("anchor", "piece").agg((F.count("*") > 1).alias("shared"), F.bool_or("twice").alias("any"), F.min(F.struct("ctx", "off")).alias("m"))
    kinds = cut(kinds.select("anchor", "piece", (F.col("shared") | F.col("any")).alias("known"), F.col("m.ctx").alias("c"), F.col("m.off").alias("o")))
    own = hot.join(kinds, ["anchor", "piece"])
    more = _sorted(own.where("ctx = c and off = o").select("anchor", "piece", F.col("known").alias("twice"), "back", "n", "bytes"), True, span)
    rest = own.where("not twice").select("anchor", "ctx", "off", "piece", "known", "n")
    whole_piece = rest.where("known").select("anchor", "ctx", F.col("off").alias("lo"), (F.col("off") + F.col("n") - 1 + span).alias("hi"))
    part_piece = rest.where("not known").join(more, ["anchor", "piece"]).select("anchor", "ctx", (F.col("off") + F.col("lo")).alias("lo"), (F.col("off") + F.col("hi")).alias("hi"))
    matched = cut(few.withColumnRenamed("piece", "ctx").union(whole_piece).union(part_piece))
    part = reps.where("not twice").select("anchor", "ctx", "d", "t", F.col("lo").alias("at")).join(matched, ["anchor", "ctx"]).select("d", "t", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi"))
    whole = places.join(classes.where("c > 1").select("anchor", "ctx"), ["anchor", "ctx"]).select("d", "t", "lo", (F.col("lo") + F.col("n") - 1 + span).alias("hi"))
    return whole.union(part)


def _removed(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[list[tuple[int, int]], bytes]:
    """The maximal runs of the intervals, and the bytes outside them."""
    if not len(lo):
        return [], raw
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
    runs = list(zip(lo[first].tolist(), reach[np.append(first[1:], len(lo)) - 1].tolist(), strict=True))
    edges = [0, *(x for run in runs for x in run), len(raw)]
    return runs, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, spans: bool = False, kept: bool = False) -> DataFrame:
    """One row for each input row: id_col, n_bytes, n_removed, n_spans, kept_sha256 (and spans, an array of (lo, hi), and the bytes kept, if asked for).

    A byte of a text in UTF-8 goes if some window of ``span`` bytes over it also begins at another place of any text, its own included; all copies go. Windows are judged on the input, and none is across two
    texts. A null text is an empty one; one shorter than a window keeps all; a null id is like any other. Repeated rows, equal ids included, are copies of each other. An empty table gives an empty
    one; other columns are not read. Texts of any length are searched whole, in parts that share a window less one byte.

    Windows that the suffix sort finds equal are compared by their bytes; contexts that are counted rather than sorted are equal by a hash of 64 bits. Beyond some ten million anchors the sieve lets most
    through, and all contexts are shuffled, about half of the text's size; the result is the same.
    """
    if not 0 < k < span:
        raise ValueError("k is below span")
    frame = _keyed(docs, id_col, text_col)
    with scope(docs.sparkSession) as keep:
        found = keep(repeats(frame, span, k).groupBy("d", "t").agg(F.collect_set(F.struct("lo", "hi")).alias("found")))
    kind = dict(frame.dtypes)["id"]
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<lo:int,hi:int>>" * spans + ", kept binary" * kept
    struct = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offset = W.buffers(batch.column("text"))
            lists = batch.column("found").fill_null([])
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten()
            lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
            out = [(int(b - a), *_removed(data[a:b].tobytes(), lo[i:j], hi[i:j])) for a, b, i, j in zip(offset[:-1], offset[1:], bounds[:-1], bounds[1:], strict=True)]
            cols = [batch.column("id"), *(pa.array(v, pa.int64()) for v in ([o[0] for o in out], [o[0] - len(o[2]) for o in out], [len(o[1]) for o in out])), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if spans:
                cols, names = [*cols, pa.array([[{"lo": a, "hi": b} for a, b in o[1]] for o in out], struct)], [*names, "spans"]
            if kept:
                cols, names = [*cols, pa.array([o[2] for o in out], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    told = frame.join(found, ["d", "t"], "left").select("id", "text", "found").mapInArrow(tidy(run), schema)
    return told.withColumnRenamed("id", id_col)
