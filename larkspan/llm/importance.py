"""Operator 4, a quality classifier by importance resampling.

Hashed n-gram models of the target (labelled good texts) and of all raw text give each document a log importance weight; the Gumbel
top-k of log weight plus Gumbel noise is a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words as W
from larkspan.llm.shared import ranked

BUCKETS = 1 << 14
MOST_TARGETS = 20_000
SMOOTHING = 1.0


_B = np.arange(256)
_LETTER = ~W.ALNUM | ((_B >= 0x41) & (_B <= 0x5A))
WORD_ENDS, MARK_ENDS = ~_LETTER, _LETTER | W.BLANK


def _features(column: pa.Array, buckets: int) -> Iterator[tuple[W.Text, np.ndarray, np.ndarray]]:
    """For each slice of texts: text number and bucket of each word (case counts), each two words in a row, and each run of punctuation."""
    for x, marks in zip(W.texts(column, WORD_ENDS), W.texts(column, MARK_ENDS), strict=True):
        at, two = x.grams(2)
        yield x, np.concatenate([x.doc, x.doc[at], marks.doc]), (np.concatenate([x.hash, two, marks.hash]) % W.U(buckets)).astype(np.int64)


def counts(docs: DataFrame, targets: np.ndarray, id_col: str, text_col: str, buckets: int) -> np.ndarray:
    """Bucket counts over all texts (row 0) and over the target texts (row 1)."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(targets))
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            ids = batch.column("id").fill_null(-1).to_numpy(zero_copy_only=False)
            chosen = np.isin(ids, held.value) & batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            for x, doc, b in _features(batch.column("text"), buckets):
                total[0] += np.bincount(b, minlength=buckets)
                total[1] += np.bincount(b[chosen[x.row + doc]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total[0]), pa.array(total[1])], ["b", "n", "t"])

    rows = frame.mapInArrow(run, "b long, n long, t long").groupBy("b").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    out = np.zeros((2, buckets), np.int64)
    out[:, rows.b.to_numpy(np.int64)] = rows[["n", "t"]].to_numpy(np.int64).T
    return out


def log_ratio(n: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw)."""
    p = (n + smoothing) / (n.sum(1, keepdims=True) + smoothing * n.shape[1])
    return np.log(p[1]) - np.log(p[0])


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, most_targets: int = MOST_TARGETS, seed: int = 17) -> DataFrame:
    """One row for each input row: id_col, n_features, log_weight, gumbel_key, sample_rank (from 0, best first) and kept.

    labels: (doc_id, quality, toxic); the target is what has quality 1 and toxic 0, of which up to ``most_targets`` ids with the smallest
    hashes are used (the bound of what the driver and executors hold). The raw model counts every text. The first keep_share of all rows by key are kept;
    None takes the share of targets among the labels, or keeps all rows if there are no labels. A null or empty text has weight 0; a null id is never a target;
    repeated rows share their noise and are kept apart; ties go by id. An empty table gives an empty one. Whole texts count.
    """
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()
    seen, fine = labels.agg(F.count("*"), F.coalesce(F.sum(good.cast("long")), F.lit(0))).first()
    share = keep_share if keep_share is not None else (fine / seen if fine else 1.0)
    targets = labels.where(good).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_targets).toPandas()
    model = docs.sparkSession.sparkContext.broadcast(log_ratio(counts(docs, targets.doc_id.to_numpy(np.int64), id_col, text_col, buckets)))
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, doc, b in _features(batch.column("text"), buckets):
                weight = np.bincount(doc, model.value[b], len(x))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(x.row, len(x)), pa.array(np.bincount(doc, minlength=len(x)).astype(np.int64)), pa.array(weight.astype(np.float64))], ["id", "n_features", "log_weight"])

    kind = dict(frame.dtypes)["id"]
    scored = frame.mapInArrow(run, f"id {kind}, n_features long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    scored = scored.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    placed = ranked(scored, [F.desc("gumbel_key"), F.asc("id")])
    return placed.select(F.col("id").alias(id_col), "n_features", "log_weight", "gumbel_key", F.col("__rank").alias("sample_rank"), (F.col("__rank") < F.round(F.col("__all") * share)).alias("kept"))
