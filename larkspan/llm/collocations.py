"""Operator 13, phrase collocation mining.

All n-grams of 1 to max_n words are exploded into rows and counted by an aggregation for each language: first by a hash of 64 bits, so that rows are small, then those frequent by it once more by their own words. Counts
of the first and last parts are joined to each phrase, scores are exact decimals, phrases that a one-word extension covers are taken out by an anti-join, and a window ranks what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm import sieve as S
from larkspan.llm import words as W
from larkspan.llm.shared import cut, partitions, small_batches, tidy

PIECE_END = np.isin(np.arange(256), np.frombuffer(b".,;:!?\n\v\f\r", np.uint8))
GAP = PIECE_END | np.isin(np.arange(256), (0x20, 0x09))
SECOND = W.Powers(0xD6E8FEB86659FD93 | 3)
SCALE = 1_000_000


class Grams:
    """The n-grams of a slice of texts that lie within one piece: first word, key (of the words and the language), and a second hash, which tells grams of one key apart."""

    def __init__(self, x: W.Text, lang: np.ndarray, max_n: int):
        ends = np.concatenate([[0], np.cumsum(PIECE_END[x.data])])
        self.x, piece, sums = x, ends[x.start], x.sums()
        other = W.prefix(W.mix(x.hash + W.U(1)), SECOND)
        at, n, key, second = [], [], [], []
        for k in range(1, max_n + 1):
            first, h = x.grams(k, sums)
            ok = piece[first] == piece[first + k - 1]
            first, h = first[ok], h[ok]
            at.append(first)
            n.append(np.full(len(first), k))
            key.append(W.mix(h ^ lang[x.doc[first]]))
            second.append(W.spans_hash(other, first, first + k, SECOND))
        self.at, self.n, self.key, self.second = (np.concatenate(v) for v in (at, n, key, second))

    def distinct(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A place of each different gram among those used, and how often it is there."""
        order = use[np.argsort(self.key[use], kind="stable")]
        if not len(order):
            return order, order
        key, second = self.key[order], self.second[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (second[1:] != second[:-1])]))
        return order[first], np.diff(np.append(first, len(order)))

    def texts(self, use: np.ndarray, n: int) -> pa.Array:
        """Their words, joined by one space; all have n words."""
        word = self.at[use][:, None] + np.arange(n)
        start, size = self.x.start[word].ravel(), (self.x.end - self.x.start)[word].ravel()
        wide = size + (np.arange(len(size)) % n < n - 1)
        to = np.concatenate([[0], np.cumsum(wide)])
        out = np.full(to[-1], 0x20, np.uint8)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to[:-1], size) + inner] = self.x.data[np.repeat(start, size) + inner]
        return pa.StringArray.from_buffers(len(use), pa.py_buffer(to[::n].astype(np.int32)), pa.py_buffer(out))


def _grams(batch: pa.RecordBatch, max_n: int) -> Iterator[Grams]:
    lang = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
    data, offset = W.buffers(batch.column("text"))
    for lo, hi in W.cuts(offset, 4 * W.SLICE_BYTES):
        x = W.split(data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo], GAP, True, lo)
        if len(x.doc):
            yield Grams(x, lang[lo:hi], max_n)


def counts(docs: DataFrame, max_n: int, least: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, n, phrase, f) of the n-grams of 1 to max_n words that a language has ``least`` times or more, and for each language with a text one of n = 0 whose f is its number of words.

    The first aggregation counts keys; what has a frequent key (by a sieve of 8 MB at most) is exploded again with its words and counted exactly, so colliding keys cost rows but change no count.
    """
    small_batches(docs.sparkSession)
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    frame = docs.select(lang.alias("lang"), F.xxhash64(lang).alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in _grams(batch, max_n):
                at, n = g.distinct(np.arange(len(g.at)))
                yield pa.RecordBatch.from_arrays([pa.array(g.key[at].view(np.int64)), pa.array(n.astype(np.int64))], ["k", "w"])

    hashed = frame.mapInArrow(tidy(keys), "k long, w long").groupBy("k").agg(F.sum("w").alias("f")).where(F.col("f") >= least)
    held = docs.sparkSession.sparkContext.broadcast(S.build(cut(hashed.select("k")), "k"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("lang")
            for g in _grams(batch, max_n):
                at, w = g.distinct(np.flatnonzero(S.passes(held.value, g.key)))
                for n in range(1, max_n + 1):
                    own = g.n[at] == n
                    use = at[own]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(g.x.doc[g.at[use]] + g.x.row)), pa.array(np.full(len(use), n, np.int32)), g.texts(use, n), pa.array(w[own].astype(np.int64))], ["lang", "n", "phrase", "w"])
                words = g.x.n_words()
                yield pa.RecordBatch.from_arrays([names.slice(g.x.row, len(words)), pa.array(np.zeros(len(words), np.int32)), pa.array([""] * len(words), pa.string()), pa.array(words.astype(np.int64))], ["lang", "n", "phrase", "w"])

    told = frame.mapInArrow(tidy(phrases), "lang string, n int, phrase string, w long").groupBy("lang", "n", "phrase").agg(F.sum("w").alias("f"))
    return cut(told.where((F.col("f") >= least) | (F.col("n") == 0)))


def _part(k_from: int | object, length: object):
    return F.array_join(F.slice("words", k_from, length), " ")


def mine(docs: DataFrame, max_n: int = 3, least: int = 10, cover: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to max_n words by score, then count, both descending, then phrase (bytes ascending).

    Texts are lower-cased in A-Z, cut into pieces at .,;:!? and line ends, and those into words at blanks and tabs. a is how often the phrase occurs within pieces, ``least`` times at
    least; l and r count the two parts of the cut with the lowest score floor(10**6 * a * a / (l * r)), the first of such cuts; n is the language's number of words. A phrase goes if a longer one
    that holds it has ``cover`` percent of its count or more. A null text has no words; a null language is und; repeated rows count each; no words give no rows; other columns are not read.

    Counts of what is rarer than ``least`` end at the aggregation: parts of a frequent phrase are frequent. As counts of extensions only fall, extensions by one word decide for all
    longer ones. a * a * 10**6 is held in DECIMAL(38, 0): right up to 5.6e15 occurrences. Ranks are found in two steps, so no task sorts a language: the first keeps ``top`` phrases of each
    language and hash bucket, which loses none of the language's.
    """
    if max_n < 2:
        raise ValueError("max_n is 2 at least")
    spark = docs.sparkSession
    every = counts(docs, max_n, least, text_col, lang_col)
    totals = every.where("n = 0").select("lang", F.col("f").alias("words_in_lang"))
    known = every.where("n > 0")
    phrases = known.where("n > 1").select("lang", "phrase", F.col("n").alias("len"), F.col("f").alias("a"))
    cuts = phrases.withColumn("words", F.split("phrase", " ")).select("*", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "len", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("len") - F.col("k")).alias("tail"))
    both = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(known.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    d = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.select("lang", "phrase", "len", "a", "k", "l", "r", (d("a") * d("a") * F.lit(SCALE).cast("decimal(7,0)")).cast("decimal(38,0)").alias("top"), (d("l") * d("r")).alias("under"))
    scored = both.select("lang", "phrase", "len", "a", F.struct(F.expr("cast(top div under as bigint)").alias("score"), "k", "l", "r").alias("c"))
    scored = scored.groupBy("lang", "phrase", "len", "a").agg(F.min("c").alias("c"))
    longer = phrases.where("len > 2").withColumn("words", F.split("phrase", " "))
    inner = F.explode(F.array(_part(F.lit(1), F.col("len") - 1), _part(F.lit(2), F.col("len") - 1)))
    longer = longer.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    s, x = scored.alias("s"), longer.alias("x")
    open_ = s.join(x, (F.col("s.lang") == F.col("x.lang")) & (F.col("s.phrase") == F.col("x.phrase")) & (100 * F.col("x.most") >= cover * F.col("s.a")), "left_anti")
    open_ = open_.select("lang", "phrase", "a", F.col("c.score").alias("score"), F.col("c.l").alias("l"), F.col("c.r").alias("r"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = open_.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark))))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "bucket")
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words_in_lang").alias("n"), "score")
