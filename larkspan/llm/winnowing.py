"""Operator 7, benchmark decontamination by winnowing.

Of the k-gram hashes in each window of SPAN words the smallest is the window's fingerprint, so any span of SPAN words that a document
shares with a benchmark item has the same fingerprint on both sides. Documents and items are joined on fingerprints, and a hit is extended to the
whole window: both windows' hashes must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import sieve as S
from larkspan.llm import words as W
from larkspan.llm.shared import cut, scope

SPAN, K = 10, 5


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def windows(x: W.Text, span: int, k: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and fingerprint of each window of ``span`` words within one text."""
    sums = x.sums() if sums is None else sums
    at, whole = x.grams(span, sums)
    if not len(at):
        return at, whole, whole
    places = np.arange(len(x.doc) - k + 1)
    grams = W.spans_hash(sums, places, places + k, W.WORDS)  # those over two texts are in no window
    return at, whole, W.mix(_sliding_min(grams, span - k + 1)[at] + W.U(span))


def item_windows(items: DataFrame, id_col: str, text_col: str, span: int, k: int) -> DataFrame:
    """Rows (fp, win, len, item) of each item's windows; an item of fewer than ``span`` words, but not none, is one window."""
    frame = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in W.texts(batch.column("text"), W.ALNUM, lower=True):
                sums, n = x.sums(), x.n_words()
                at, win, fp = windows(x, span, k, sums)
                short = np.flatnonzero((n > 0) & (n < span))
                h = W.spans_hash(sums, x.first[short], x.first[short + 1], W.WORDS)
                doc = np.concatenate([x.doc[at], short]).astype(np.int64)
                length = np.concatenate([np.full(len(at), span), n[short]]).astype(np.int32)
                fps = np.concatenate([fp, W.mix(h + n[short].astype(W.U))])
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.concatenate([win, h]).view(np.int64)), pa.array(length), batch.column("item").take(pa.array(doc + x.row))], ["fp", "win", "len", "item"])

    return frame.mapInArrow(run, "fp long, win long, len int, item string").distinct()


def _candidates(docs: DataFrame, text_col: str, bits: np.ndarray, lengths: list[int], span: int, k: int) -> DataFrame:
    """Each row with n_words and its windows whose fingerprints may be an item's."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    others = [c for c in docs.columns if c != text_col]
    kinds = dict(docs.dtypes)
    struct = pa.struct([("fp", pa.int64()), ("win", pa.int64()), ("at", pa.int32()), ("len", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in W.texts(batch.column(text_col), W.ALNUM, lower=True):
                sums, parts = x.sums(), []
                for n in lengths:
                    if n == span:
                        at, win, fp = windows(x, span, k, sums)
                    else:
                        at, win = x.grams(n, sums)
                        fp = W.mix(win + W.U(n))
                    ok = S.passes(held.value, fp)
                    parts.append((at[ok], win[ok], fp[ok], np.full(int(ok.sum()), n)))
                at, win, fp, n = (np.concatenate(p) if parts else np.zeros(0, np.int64) for p in (zip(*parts, strict=True) if parts else [()] * 4))
                order = np.argsort(at, kind="stable")
                at, win, fp, n = at[order], win[order], fp[order], n[order]
                doc = x.doc[at]
                found = pa.StructArray.from_arrays([pa.array(fp.astype(W.U).view(np.int64)), pa.array(win.astype(W.U).view(np.int64)), pa.array((at - x.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], fields=list(struct))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(x) + 1)).astype(np.int32)), found)
                own = batch.slice(x.row, len(x))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in others), pa.array(x.n_words().astype(np.int64)), lists], [*others, "__n", "__found"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "__n long, __found array<struct<fp:long,win:long,at:int,len:int>>"])
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each input row: id_col, n_words, n_hit (words inside windows of items), n_items, items_sha256, contaminated; columns of
    ``keep`` are carried.

    Words are runs of digits, ASCII letters in lower case, and non-ASCII characters. A null or empty text has no words and no hits; an item without words
    has no windows; one without an id hits but is neither counted nor listed; no items means no hits. Equal items each count. Repeated rows each get their result. Texts of any length are searched
    whole. An empty table gives an empty one.

    What goes to every executor is the items' bit sieve (8 MB at most). The joins on fingerprints are Spark's to plan: it broadcasts the items' side
    while that is small and shuffles beyond. Both sides have been cut down to candidates by then.
    """
    spark = docs.sparkSession
    wins = cut(item_windows(items, item_id, item_text, span, k))
    lengths = sorted(r[0] for r in wins.select("len").distinct().collect())  # up to ``span`` numbers
    carried = list(dict.fromkeys((id_col, *keep)))
    frame = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").alias("__text"))
    base = cut(_candidates(frame, "__text", S.build(wins, "fp"), lengths, span, k).withColumn("__row", F.monotonically_increasing_id()))
    known = wins.select("fp", "win", "len").distinct()
    hits = base.where(F.size("__found") > 0).select("__row", F.explode("__found").alias("f")).select("__row", "f.*").join(known, ["fp", "win", "len"])
    hits = cut(hits)
    spans = hits.groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("len")).alias("to")))).alias("s"))
    union = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["to"], s["at"]))).cast("long").alias("n"), F.greatest(a["to"], s["to"]).alias("to")),
        lambda a: a["n"],
    )
    found = hits.select("__row", "fp", "win", "len").distinct().join(wins.where("item is not null"), ["fp", "win", "len"]).groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = base.drop("__found").join(spans.select("__row", union.alias("h")), "__row", "left").join(found, "__row", "left")
    names = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("h", F.lit(0).cast("long"))
    return out.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carried)],
        F.col("__n").alias("n_words"),
        hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, that share no window with an item."""
    renamed = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*renamed.values())
    id_col, text_col = renamed[options.pop("id_col", "doc_id")], renamed[options.pop("text_col", "text")]
    rows = rows.withColumn("__hash", F.xxhash64(text_col))
    with scope(docs.sparkSession) as kept:  # what is left behind are places of contaminated texts, no texts
        told = contamination(rows, items, id_col=id_col, text_col=text_col, keep=("__hash",), **options)
        hit = kept(told.where("contaminated").select(F.col(id_col).alias("__id"), "__hash").distinct())
    sure, rest = S.apart(rows, hit, "__hash")
    clear = rest.join(hit.withColumnRenamed("__hash", "__h"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__h")), "left_anti")
    return sure.union(clear).drop("__hash").toDF(*docs.columns)
