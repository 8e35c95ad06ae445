"""Words of many texts at once, in numpy on Arrow's buffers.

A batch's texts lie end to end in one UTF-8 buffer, so that finding words, hashing them and hashing windows of them are a few
passes over arrays instead of a loop over words. Hashes have 64 bits: polynomials modulo 2**64 with odd bases, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3
SLICE_BYTES = 1 << 18  # texts looked at together; a longer text is a slice of its own

def separators(kept: str) -> np.ndarray:
    """True for each byte that ends words. kept: "blank" (words are all but 0x20 and 0x09-0x0D) or "alnum" (words are 0-9, a-z and non-ASCII)."""
    b = np.arange(256)
    if kept == "blank":
        return (b == 0x20) | ((b >= 9) & (b <= 13))
    return ~(((b >= 0x30) & (b <= 0x39)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80))


BLANK, ALNUM = separators("blank"), separators("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, lengthened as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, base, U)
                x[0] = 1
                np.multiply.accumulate(x, out=x)
                setattr(self, name, x)
        return self.up, self.down


BYTES, WORDS = Powers(BYTE_BASE), Powers(WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Sums of values[:i] * base**i, one more than there are values."""
    out = np.zeros(len(values) + 1, U)
    np.multiply(values, powers.of(len(values) + 1)[0][: len(values)], out=out[1:])
    np.cumsum(out, out=out)
    return out


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each span of the values that ``sums`` was made of; equal content gives equal hashes anywhere."""
    return mix((sums[end] - sums[start]) * powers.of(len(sums))[1][start] + (end - start).astype(U))


@dataclass
class Text:
    """Some texts, their words and the hash of each word."""

    row: int  # of the first text in its batch
    data: np.ndarray  # bytes, lower-cased if asked for
    offset: np.ndarray  # of each text in data, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    doc: np.ndarray  # of each word, from 0 in this slice
    first: np.ndarray  # word number where each text begins, and the end
    hash: np.ndarray

    def __len__(self) -> int:
        return len(self.offset) - 1

    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, n: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Word number and hash of each window of n words within one text."""
        at = np.arange(max(0, len(self.doc) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        return at, spans_hash(self.sums() if sums is None else sums, at, at + n, WORDS)

    def sums(self) -> np.ndarray:
        return prefix(self.hash, WORDS)

    def words(self, doc: int) -> list[bytes]:
        o, own = self.offset[doc], slice(self.first[doc], self.first[doc + 1])
        raw = self.data[o : self.offset[doc + 1]].tobytes()
        return [raw[a:b] for a, b in zip((self.start[own] - o).tolist(), (self.end[own] - o).tolist(), strict=True)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def cuts(offset: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of up to ``most`` bytes, one text at least; every text is in one whole."""
    lo = 0
    while lo < len(offset) - 1:
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def texts(column: pa.Array, separator: np.ndarray = BLANK, lower: bool = False) -> Iterator[Text]:
    """The texts of a column in slices, split into words."""
    data, offset = buffers(column)
    for lo, hi in cuts(offset):
        yield split(data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo], separator, lower, lo)


def split(data: np.ndarray, offset: np.ndarray, separator: np.ndarray, lower: bool, row: int = 0) -> Text:
    if lower:
        data = LOWER[data]
    n = len(data)
    word = ~separator[data]
    edge = np.zeros(n + 1, bool)  # True where a text begins
    edge[offset] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offset)
    doc = np.repeat(np.arange(len(offset) - 1, dtype=np.int64), np.diff(first))
    h = spans_hash(prefix(data.astype(U) + U(1), BYTES), start, end, BYTES)
    return Text(row, data, offset, start, end, doc, first, h)


def sums_by(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between each two bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def covered(at: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """True for each of n places inside one of the spans."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def repeated(key: np.ndarray) -> np.ndarray:
    """Places whose value is found twice or more, in order."""
    s = np.sort(key)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == key)


def later(key: np.ndarray) -> np.ndarray:
    """Places whose value is also found at an earlier place."""
    at = repeated(key)
    order = at[np.argsort(key[at], kind="stable")]
    return np.sort(order[1:][key[order][1:] == key[order][:-1]])
