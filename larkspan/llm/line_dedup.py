"""Operator 5, line dedup by MinHash: one line stays of each group of alike lines.

A line's character shingles get a one-permutation MinHash signature, bands of it bring likely pairs together, their exact Jaccard similarity is
verified, and a distributed union-find joins verified pairs into components. Of each component the first line in (id, line number) order stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sieve as S
from larkspan.llm import words as W
from larkspan.llm.linking import PARITY, connect, distinct_groups, near, open_groups, parities
from larkspan.llm.shared import cut, scope, tidy

SHINGLE, BANDS, ROWS = 8, 8, 3  # a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**3)**8 = 0.997
PERCENT = 80
SLACK = 64  # rounds of one centre go on in groups with more open pairs a row than that; in others the last join makes them at less cost
FEW_PAIRS = 1 << 16  # pairs to verify whose keys are broadcast to pick their lines: 1 MB
RECENT_BITS = 18  # keys that a task remembers, so that a line repeated soon again is not signed again


class Lines:
    """The lines of a slice of texts: bounds without the line end, text number, number within the text, hash, and characters."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offset: np.ndarray):
        self.lo, self.data, self.offset = lo, data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo]
        d, o = self.data, self.offset
        newline = np.flatnonzero(d == 10)
        own = np.diff(np.searchsorted(newline, o))  # line ends of each text; it has one line more
        doc = np.repeat(np.arange(len(o) - 1), own + 1)
        first = np.concatenate([[0], np.cumsum(own + 1)])
        self.number = np.arange(len(doc)) - first[doc]
        begin = np.empty(len(doc), np.int64)
        begin[first[:-1]] = o[:-1]
        later = np.ones(len(doc), bool)
        later[first[:-1]] = False
        begin[later] = newline + 1
        stop = np.empty(len(doc), np.int64)
        stop[first[1:] - 1] = o[1:]
        inner = np.ones(len(doc), bool)
        inner[first[1:] - 1] = False
        stop[inner] = newline
        self.begin, self.stop, self.doc, self.first = begin, stop, doc, first
        self.sums = W.prefix(d.astype(W.U) + W.U(1), W.BYTES)
        self.key = W.spans_hash(self.sums, begin, stop, W.BYTES)

    @cached_property
    def inner(self) -> np.ndarray:
        """Places of the bytes within characters: all but their first."""
        return np.flatnonzero((self.data & 0xC0) == 0x80)

    def chars(self, lines: np.ndarray) -> np.ndarray:
        """How many characters each of the lines has."""
        begin, stop = self.begin[lines], self.stop[lines]
        return stop - begin - (np.searchsorted(self.inner, stop) - np.searchsorted(self.inner, begin))

    def shingles(self, lines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Line (place in ``lines``) and hash of each run of k characters within the chosen lines."""
        n = np.maximum(self.chars(lines) - k + 1, 0)
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, W.U)
        first, sums, inverse = self.begin[lines], self.sums, W.BYTES.of(len(self.sums))[1][: len(self.sums)]
        if len(self.inner):  # from bytes to characters
            lead = np.ones(len(sums), bool)
            lead[self.inner] = False
            ends = np.flatnonzero(lead)
            first, sums, inverse = first - np.searchsorted(self.inner, first), sums[ends], inverse[ends]
        h = sums[k:] - sums[:-k]
        h *= inverse[:-k]
        at = np.repeat(first - (np.cumsum(n) - n), n)
        at += np.arange(total)
        h = h[at]
        h ^= h >> W.U(32)
        h *= W.U(0x9FB21C651E98DF25)
        h ^= h >> W.U(29)
        return np.repeat(np.arange(len(lines)), n), h

    def chosen(self) -> np.ndarray:
        """Whether each line has a word. Most begin with one; the others are looked through."""
        ok = (self.begin < self.stop) & ~W.BLANK[self.data[np.minimum(self.begin, len(self.data) - 1)]] if len(self.data) else np.zeros(len(self.begin), bool)
        rest = np.flatnonzero(~ok & (self.begin < self.stop))
        if len(rest):
            size = self.stop[rest] - self.begin[rest]
            before = np.cumsum(size) - size
            word = ~W.BLANK[self.data[np.repeat(self.begin[rest] - before, size) + np.arange(size.sum())]]
            ok[rest] = np.logical_or.reduceat(word, before)
        return ok

    def texts(self, lines: np.ndarray) -> pa.Array:
        size = self.stop[lines] - self.begin[lines]
        offset = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.begin[lines] - offset[:-1], size) + np.arange(offset[-1])
        return pa.StringArray.from_buffers(len(lines), pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(self.data[flat].tobytes()))


def _lines(column: pa.Array) -> Iterator[Lines]:
    data, offset = W.buffers(column)
    for lo, hi in W.cuts(offset):
        yield Lines(lo, hi, data, offset)


class Recent:
    """A table of bounded size of keys that were seen: forgets a key where another takes its place."""

    def __init__(self):
        self.slot = np.zeros(1 << RECENT_BITS, W.U)

    def new(self, key: np.ndarray) -> np.ndarray:
        """Places of keys that are not remembered, each key's first only; remembers them."""
        at = np.unique(key, return_index=True)[1]
        place = (key[at] >> W.U(64 - RECENT_BITS)).astype(np.int64)
        at, place = at[self.slot[place] != key[at]], place[self.slot[place] != key[at]]
        self.slot[place] = key[at]
        return np.sort(at)


def signature(doc: np.ndarray, h: np.ndarray, n: int, bins: int) -> np.ndarray:
    """n x bins one-permutation MinHash; an empty bin takes a full one's value, found by hashing (optimal densification). A set without elements gets the greatest value in every bin."""
    cell = ((h >> W.U(48)) * W.U(bins) >> W.U(16)).view(np.int64)
    cell += doc * bins
    least = np.full(n * bins, np.iinfo(np.uint64).max, W.U)
    np.minimum.at(least, cell, h)  # the bin is of the high bits, which leaves the order within it even
    out = least.reshape(n, bins)
    empty = out == np.iinfo(np.uint64).max
    row, col = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    tries = 0
    while len(row):
        tries += 1
        donor = (W.mix(col.astype(W.U) * W.U(1000003) + W.U(tries)) % W.U(bins)).astype(np.int64)
        ok = ~empty[row, donor]
        out[row[ok], col[ok]] = W.mix(out[row[ok], donor[ok]] + W.U(1))
        row, col = row[~ok], col[~ok]
    return out


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _signed(frame: DataFrame) -> DataFrame:
    """Rows (id, tkey, no, key, bands) of the lines with a word; bands is null for a line that the task had lately, or that has no shingle and so is like equal ones only."""
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for x in _lines(batch.column("text")):
                use = np.flatnonzero(x.chosen())
                if not len(use):
                    continue
                long = np.flatnonzero(x.chars(use) >= SHINGLE)
                at = long[recent.new(x.key[use[long]])]
                new = use[at]
                fresh = np.zeros(len(use), bool)
                fresh[at] = True
                sig = signature(*x.shingles(new, SHINGLE), len(new), BANDS * ROWS) if len(new) else np.zeros((0, BANDS * ROWS), W.U)
                band = np.zeros((len(new), BANDS), W.U)
                for r in range(ROWS):
                    band = W.mix(band + sig[:, r::ROWS][:, :BANDS])
                band = W.mix(band + np.arange(BANDS, dtype=W.U))
                offsets = np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), _longs(band.ravel()), mask=pa.array(~fresh))
                text = W.spans_hash(x.sums, x.offset[:-1], x.offset[1:], W.BYTES)
                ids = batch.column("id").take(pa.array(x.doc[use] + x.lo))
                yield pa.RecordBatch.from_arrays([ids, _longs(text[x.doc[use]]), pa.array(x.number[use].astype(np.int32)), _longs(x.key[use]), lists], ["id", "tkey", "no", "key", "bands"])

    return frame.mapInArrow(tidy(run), f"id {kind}, tkey long, no int, key long, bands array<long>")


def _texts(frame: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, line, n, parities) of the wanted line keys, one for each: the line, how many distinct shingles it has, and their parities."""
    held = frame.sparkSession.sparkContext.broadcast(S.build(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Recent()
        for batch in batches:
            for x in _lines(batch.column("text")):
                ok = np.flatnonzero(S.passes(held.value, x.key))
                ok = ok[x.chars(ok) >= SHINGLE]
                new = ok[recent.new(x.key[ok])]
                if len(new):
                    line = x.texts(new)
                    own = Lines(0, len(new), *W.buffers(line))  # of what is wanted only
                    doc, h = _distinct(*own.shingles(np.arange(len(new)), SHINGLE), len(new))
                    yield pa.RecordBatch.from_arrays([_longs(x.key[new]), line, pa.array(np.bincount(doc, minlength=len(new)).astype(np.int64)), *parities(doc, h, len(new))], ["key", "line", "n", *PARITY])

    kinds = ", ".join(["key long, line string, n long", *(f"{p} long" for p in PARITY)])
    return frame.mapInArrow(tidy(run), kinds).join(wanted, "key", "left_semi").dropDuplicates(["key"])


def _room(n: int) -> np.uint64:
    """The bits that a line's hash has beside its number, of n."""
    return W.U(64 - max(1, (n - 1).bit_length()))


def _packed(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct (line, hash) in order; line, of n, and hash share 64 bits for that, so that one plain sort does."""
    room = _room(n)
    key = np.sort((doc.astype(W.U) << room) | (h >> (W.U(64) - room)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return key[new]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    key, room = _packed(doc, h, n), _room(n)
    return (key >> room).astype(np.int64), key << (W.U(64) - room)


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) whose lines have alike sets of shingles."""
        for batch in batches:
            own = sum(np.diff(W.buffers(batch.column(side))[1]) for side in ("la", "lb")) + 64
            for lo, hi in W.cuts(np.concatenate([[0], np.cumsum(own)])):  # by bytes: a line can be a whole long text
                part = batch.slice(lo, hi - lo)
                sets = []
                for side in ("la", "lb"):
                    data, offset = W.buffers(part.column(side))
                    flat = data.copy()
                    flat[flat == 10] = 32  # lines have no line ends
                    x = Lines(0, part.num_rows, flat, offset)
                    sets.append(_packed(*x.shingles(np.arange(part.num_rows), SHINGLE), part.num_rows))
                key = np.sort(np.concatenate(sets), kind="stable")  # of two sorted runs
                doc = (key >> _room(part.num_rows)).astype(np.int64)
                both = np.bincount(doc[1:][key[1:] == key[:-1]], minlength=part.num_rows)
                total = np.bincount(doc, minlength=part.num_rows)
                ok = np.flatnonzero(both * 100 >= percent * (total - both))
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    return run


def removed(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Rows (id, tkey, nos) of the line numbers that go from a text."""
    with scope(docs.sparkSession) as kept:
        return kept(_removed(docs, id_col, text_col, percent))


def _removed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    lines = cut(_signed(frame), **{"parquet.enable.dictionary#bands.list.element": "false"})
    bands = lines.where("bands is not null").select("key", F.explode("bands").alias("sig"))
    shared = cut(open_groups(bands).distinct())
    shared = cut(distinct_groups(shared))
    texts = cut(_texts(frame, shared.select("key").distinct()))

    def similar(pairs: DataFrame) -> DataFrame:
        held = texts
        if pairs.count() <= FEW_PAIRS:  # the others' lines aren't shuffled
            held = texts.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("key"))), "key", "left_semi")
        side = lambda s: held.select(F.col("key").alias(s), F.col("line").alias(f"l{s}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "la", "lb").mapInArrow(tidy(_verified(percent)), "a long, b long")

    roots = connect(shared, texts.select("key", "n", *PARITY), near("x", "y", percent), similar, more=4, slack=SLACK).withColumnRenamed("node", "key")
    # of the lines only those that are found twice or linked go on, and of these each group's first place is found
    place = F.struct(F.col("id"), F.col("no"), F.col("tkey"))
    keys = lines.groupBy("key").agg(F.count("*").alias("n")).join(roots, "key", "full").where("n > 1 or root is not null")
    several = cut(keys.select("key", F.coalesce("root", "key").alias("root")))
    held = cut(lines.select("id", "tkey", "no", "key").join(several, "key").drop("key"))
    gone = held.join(held.groupBy("root").agg(F.min(place).alias("first")), "root").where(~place.eqNullSafe(F.col("first")))
    return gone.groupBy("id", "tkey").agg(F.collect_set("no").alias("nos"))


def _text_keys(data: np.ndarray, offset: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The keys of whole texts, as _signed gives them."""
    o = offset[lo : hi + 1] - offset[lo]
    return W.spans_hash(W.prefix(data[offset[lo] : offset[hi]].astype(W.U) + W.U(1), W.BYTES), o[:-1], o[1:], W.BYTES)


def _left(text: str, nos: list[int] | None) -> list[str]:
    lines = text.split("\n")
    gone = set(nos or ())
    return [line for i, line in enumerate(lines) if i not in gone] if gone else lines


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, keep: tuple[str, ...] = (), text: bool = False) -> DataFrame:
    """One row for each input row: id_col, n_lines, n_removed, kept_sha256 of the kept lines joined by line ends (and kept_text if ``text``).

    Two lines are alike when 100 * |intersection| >= percent * |union| of their sets of SHINGLE-character runs; equal lines are. Blank lines
    are left alone, and a line of fewer than SHINGLE characters is like equal ones only. Of each component the line that comes first by (id, number, text) stays, wherever else it goes. A null text is one empty line. Rows with equal ids
    and texts are one place and keep or lose the same lines; rows with equal ids and different texts are kept apart; a null id comes first.
    An empty table gives an empty one. Columns of ``keep`` are carried.
    """
    gone = removed(docs, id_col, text_col, percent)
    held = docs.sparkSession.sparkContext.broadcast(S.build(gone, "tkey"))
    carried = list(dict.fromkeys((id_col, *keep)))
    frame = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").alias("text"))
    kinds = dict(frame.dtypes)
    names = [f"c{i}" for i in range(len(carried))]
    made = ["n_lines", "n_removed", "sha", *(["kept"] if text else [])]

    def results(rows: list[tuple[str, list | None]]) -> list[pa.Array]:
        joined = ["\n".join(_left(t, nos)) if t and nos else t or "" for t, nos in rows]
        n = [(t or "").count("\n") + 1 for t, _ in rows]
        cols = [pa.array(n, pa.int64()), pa.array([len(set(nos or ())) for _, nos in rows], pa.int64()), pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string())]
        return [*cols, *([pa.array(joined, pa.string())] if text else [])]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that lose nothing by the sieve are done; the rest go on as they are."""
        for batch in batches:
            data, offset = W.buffers(batch.column("text"))
            for lo, hi in W.cuts(offset):
                own = batch.slice(lo, hi - lo)
                key = _text_keys(data, offset, lo, hi)
                maybe = S.passes(held.value, key)
                for flag in (False, True):
                    at = pa.array(np.flatnonzero(maybe == flag))
                    if not len(at):
                        continue
                    part = own.take(at)
                    n = part.num_rows
                    head = [*(part.column(c) for c in names), _longs(key[maybe == flag])]
                    if flag:
                        tail = [part.column("text").fill_null(""), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *([pa.nulls(n, pa.string())] if text else [])]
                    else:
                        tail = [pa.nulls(n, pa.string()), *results([(t, None) for t in part.column("text").to_pylist()])]
                    yield pa.RecordBatch.from_arrays([*head, *tail], [*names, "tkey", "text", *made])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = batch.column("text").is_null()
            part, rest = batch.filter(done), batch.filter(pc.invert(done))
            yield part.select([*names, *made])
            rows = list(zip(rest.column("text").to_pylist(), rest.column("nos").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([*(rest.column(c) for c in names), *results(rows)], [*names, *made])

    kept_kind = ", kept string" if text else ""
    carried_kinds = ", ".join(f"{c} {kinds[c]}" for c in names)
    told = frame.mapInArrow(tidy(first), f"{carried_kinds}, tkey long, text string, n_lines long, n_removed long, sha string{kept_kind}")
    nos = gone.withColumnsRenamed({"id": "gid", "tkey": "gkey"})
    told = told.join(nos, F.col("c0").eqNullSafe(F.col("gid")) & (F.col("tkey") == F.col("gkey")), "left").select(*names, "text", "nos", *made)  # done texts are shuffled as their results
    out = told.mapInArrow(tidy(last), f"{carried_kinds}, n_lines long, n_removed long, sha string{kept_kind}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, carried, strict=True)], "n_lines", "n_removed", F.col("sha").alias("kept_sha256"), *([F.col("kept").alias("kept_text")] if text else []))


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with their own columns, each text cut down to the lines it keeps; a row that loses every line with a word goes, and n_chars follows the text."""
    names = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    frame, kinds = docs.toDF(*names.values()), dict(docs.dtypes)
    own_id, own_text = names[id_col], names[text_col]
    gone = removed(frame, own_id, own_text, percent)
    held = docs.sparkSession.sparkContext.broadcast(S.build(gone, "tkey"))

    def side(flag: bool) -> DataFrame:
        """The rows that may lose lines by the sieve, or those that lose none, with their text's key."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offset = W.buffers(batch.column(own_text))
                for lo, hi in W.cuts(offset):
                    key = _text_keys(data, offset, lo, hi)
                    ok = pa.array(S.passes(held.value, key) == flag)
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*(part.column(c).filter(ok) for c in names.values()), _longs(key).filter(ok)], [*names.values(), "__tkey"])

        return frame.mapInArrow(tidy(run), ", ".join([*(f"{n} {kinds[c]}" for c, n in names.items()), "__tkey long"]))

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(own_text).to_pylist(), batch.column("__nos").to_pylist(), strict=True)
            text = [t if nos is None or t is None else "\n".join(_left(t, nos)) for t, nos in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array(text, pa.string()) if c == own_text else batch.column(c) for c in names.values()), pc.list_value_length(batch.column("__nos")).cast(pa.int64())], [*names.values(), "__n"])

    nos = gone.select(F.col("id").alias("__gid"), F.col("tkey").alias("__gkey"), F.col("nos").alias("__nos"))
    rest = side(True).join(nos, F.col(own_id).eqNullSafe(F.col("__gid")) & (F.col("__tkey") == F.col("__gkey")), "left").select(*names.values(), "__nos")
    rest = rest.mapInArrow(tidy(lose), ", ".join([*(f"{n} {kinds[c]}" for c, n in names.items()), "__n long"])).where(F.col("__n").isNull() | F.col(own_text).rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        rest = rest.withColumn(names["n_chars"], F.when(F.col("__n") > 0, F.char_length(own_text).cast(kinds["n_chars"])).otherwise(F.col(names["n_chars"])))
    return side(False).select(*names.values()).union(rest.select(*names.values())).toDF(*docs.columns)
