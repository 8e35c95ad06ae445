"""Operator 1, quality rules by repetition coverage.

Rolling hashes of several n-gram lengths and of lines, in numpy, measure which share of a text's characters lies inside n-grams
and lines that the same text has had before. A text fails where a share is above its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larkspan.llm import words as W

# A fifth of the characters may be repetition; short texts with one repeated sentence stay below that.
GRAM_LIMITS = {5: 0.20, 7: 0.20, 10: 0.20}
LINE_CHAR_LIMIT = 0.20
LINE_LIMIT = 0.30

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


@dataclass(frozen=True)
class Rules:
    """Thresholds; a share above its threshold fails the text.

    gram_limits: by n, the share of word characters inside n-grams seen earlier in the text. line_char_limit, line_limit: shares of
    characters in, and number of, lines equal to an earlier line. symbol_limit: symbols to words. min_words, repeat_limit: the base rule.
    """

    gram_limits: dict[int, float] = field(default_factory=lambda: dict(GRAM_LIMITS))
    line_char_limit: float = LINE_CHAR_LIMIT
    line_limit: float = LINE_LIMIT
    symbol_limit: float = 0.10
    min_words: int = 50
    repeat_limit: float = 0.50


def _shares(x: W.Text, rules: Rules) -> dict[str, np.ndarray]:
    """Measures of each text of a slice."""
    n_docs, n_words = len(x), x.n_words()
    chars = (x.data & 0xC0) != 0x80  # one for each code point
    total = np.zeros(len(x.data) + 1, np.int64)
    np.cumsum(chars, out=total[1:])
    length = total[x.end] - total[x.start]
    out = {"n_words": n_words, "word_chars": W.sums_by(length, x.first), "n_symbols": W.sums_by(_SYMBOL[x.data], x.offset)}

    # lines with a word; a text's end ends a line
    newline = np.flatnonzero(x.data == 10)
    begin = np.sort(np.concatenate([newline + 1, x.offset[:-1]]))
    begin = begin[begin < len(x.data)] if len(x.data) else begin[:0]
    begin = np.unique(begin)
    stop = np.append(begin[1:], len(x.data))
    stop = np.where((stop > begin) & (x.data[stop - 1] == 10), stop - 1, stop) if len(begin) else stop[:0]
    worded = np.searchsorted(x.start, stop) > np.searchsorted(x.start, begin)
    begin, stop = begin[worded], stop[worded]
    doc = np.searchsorted(x.offset, begin, "right") - 1
    sums = W.prefix(x.data.astype(W.U) + W.U(1), W.BYTES)
    key = W.mix(W.spans_hash(sums, begin, stop, W.BYTES) + W.mix(doc.astype(W.U)))
    again = W.later(key)
    line_chars = total[stop] - total[begin]
    out["n_lines"] = np.bincount(doc, minlength=n_docs)
    out["n_dup_lines"] = np.bincount(doc[again], minlength=n_docs)
    out["dup_line_chars"] = np.bincount(doc[again], line_chars[again], n_docs).astype(np.int64)
    out["line_chars"] = np.bincount(doc, line_chars, n_docs).astype(np.int64)

    sums, salt = x.sums(), W.mix(x.doc.astype(W.U) + W.U(1))
    for n in sorted({3, *rules.gram_limits}):
        at, h = x.grams(n, sums)
        key = W.mix(h + salt[at])
        if n == 3:
            out["n_repeat_words"] = W.sums_by(W.covered(at[W.repeated(key)], 3, len(x.doc)), x.first)
        if n in rules.gram_limits:
            out[f"dup_{n}gram_chars"] = W.sums_by(length * W.covered(at[W.later(key)], n, len(x.doc)), x.first)
    return out


def _verdict(m: dict[str, np.ndarray], rules: Rules) -> dict[str, np.ndarray]:
    share = lambda a, b: a / np.maximum(b, 1)
    m["base_failed"] = (m["n_words"] < rules.min_words) | (m["n_repeat_words"] > rules.repeat_limit * m["n_words"])
    bad = m["base_failed"] | (share(m["n_symbols"], m["n_words"]) > rules.symbol_limit)
    bad |= share(m["dup_line_chars"], m["line_chars"]) > rules.line_char_limit
    bad |= share(m["n_dup_lines"], m["n_lines"]) > rules.line_limit
    for n, limit in rules.gram_limits.items():
        bad |= share(m[f"dup_{n}gram_chars"], m["word_chars"]) > limit
    m["kept"] = ~bad
    return m


def columns(rules: Rules) -> list[tuple[str, str]]:
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "dup_line_chars", *(f"dup_{n}gram_chars" for n in sorted(rules.gram_limits))]
    return [*((c, "long") for c in longs), ("base_failed", "boolean"), ("kept", "boolean")]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures and verdict of each text, one row for each input row.

    Returns id_col, the measures of columns(), base_failed and kept; columns named in ``keep`` are carried (a measure with the
    same name wins). A null or empty text has no words and fails the base rule. Long texts are measured whole. Repeated rows give repeated
    results; an empty table gives an empty one. Other columns are not read.
    """
    rules = rules or Rules()
    made = columns(rules)
    carried = [c for c in dict.fromkeys((id_col, *keep)) if c not in {n for n, _ in made}]
    frame = docs.select(*dict.fromkeys([*carried, text_col]))
    kinds = dict(frame.dtypes)
    schema = ", ".join(f"`{c}` {k}" for c, k in [*((c, kinds[c]) for c in carried), *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in W.texts(batch.column(text_col)):
                m = _verdict(_shares(x, rules), rules)
                own = batch.slice(x.row, len(x))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in carried), *(pa.array(m[n], pa.int64() if k == "long" else pa.bool_()) for n, k in made)], [*carried, *(n for n, _ in made)])

    return frame.mapInArrow(run, schema)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """The rows whose text passes, with their own columns only; see measure()."""
    renamed = {c: f"__in_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*renamed.values())
    kept = measure(inner, renamed[id_col], renamed[text_col], rules, tuple(renamed.values())).where("kept")
    return kept.select(*renamed.values()).toDF(*docs.columns)
