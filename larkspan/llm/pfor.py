"""Patched frame-of-reference blocks: the file format of token ids.

A block holds up to BLOCK ids: the minimum, differences to it packed at the width that PERCENTILE of them fit, and the list of the others (place and full
difference). A file is MAGIC, the blocks, and a footer: document ids, their token counts, where each block starts, the total, and the footer's size, so that any id can be
found by reading the footer and one block.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np

MAGIC = b"LPF1"
BLOCK = 128
PERCENTILE = 90
_HEAD = struct.Struct("<IBBH")  # minimum, width, exceptions, ids
_TAIL = struct.Struct("<QQQQ4s")  # documents, blocks, ids, footer bytes, magic


def _lengths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(x.astype(np.float64))[1]


def pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of the ids and the size of each; the last may be short."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", np.zeros(0, np.int64)
    full = np.full(n * BLOCK, ids[-1], np.uint32)
    full[: len(ids)] = ids
    grid = full.reshape(n, BLOCK)
    least = grid.min(1)
    diff = grid - least[:, None]
    bits = _lengths(diff)
    width = np.partition(bits, BLOCK * PERCENTILE // 100 - 1, axis=1)[:, BLOCK * PERCENTILE // 100 - 1].astype(np.int64)
    over = bits > width[:, None]
    count = over.sum(1)
    body = np.zeros((n, BLOCK * 4), np.uint8)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        if w:
            spread = np.unpackbits(diff[own].view(np.uint8), bitorder="little").reshape(len(own), BLOCK, 32)[:, :, :w]
            body[own, : BLOCK * w // 8] = np.packbits(spread.reshape(len(own), -1), axis=1, bitorder="little")
    held = np.full(n, BLOCK)
    held[-1] = len(ids) - (n - 1) * BLOCK
    row, place = np.nonzero(over)
    first = np.concatenate([[0], np.cumsum(count)])
    place, value, parts = place.astype(np.uint8), diff[row, place].astype("<u4"), []
    for i, (m, w, c, k) in enumerate(zip(least.tolist(), width.tolist(), count.tolist(), held.tolist(), strict=True)):
        a, b = first[i], first[i + 1]
        parts.append(_HEAD.pack(m, w, c, k) + body[i, : BLOCK * w // 8].tobytes() + place[a:b].tobytes() + value[a:b].tobytes())
    return b"".join(parts), _HEAD.size + BLOCK * width // 8 + 5 * count


def unpack(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at ``starts``."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(_HEAD.size)]
    least = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, count = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    held = np.ascontiguousarray(head[:, 6:8]).view("<u2").ravel().astype(np.int64)
    diff = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            own = np.flatnonzero(width == w)
            packed = raw[(starts[own] + _HEAD.size)[:, None] + np.arange(BLOCK * w // 8)]
            wide = np.zeros((len(own), BLOCK, 32), np.uint8)
            wide[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(own), BLOCK, w)
            diff[own] = np.packbits(wide.reshape(len(own), -1), axis=1, bitorder="little").view("<u4")
    row = np.repeat(np.arange(n), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = (starts + _HEAD.size + BLOCK * width // 8)[row]
    place = raw[at + nth]
    value = np.ascontiguousarray(raw[(at + count[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
    diff[row, place] = value
    ids = diff + least[:, None]
    return ids.ravel() if (held == BLOCK).all() else ids[np.arange(BLOCK) < held[:, None]]


class Writer:
    """Appends documents to a binary stream; memory holds one part of the ids and the footer."""

    def __init__(self, out: BinaryIO, part: int = 1 << 14):
        self.out, self.part, self.docs, self.counts, self.sizes, self.rest, self.total = out, part * BLOCK, [], [], [], np.zeros(0, np.uint32), 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> None:
        self.docs += doc_ids
        self.counts += counts
        self.total += len(ids)
        self.rest = np.concatenate([self.rest, ids.astype(np.uint32)])
        while len(self.rest) >= self.part:
            self._flush(self.part)

    def _flush(self, n: int) -> None:
        data, sizes = pack(self.rest[:n])
        self.out.write(data)
        self.sizes.append(sizes)
        self.rest = self.rest[n:]

    def close(self) -> None:
        if len(self.rest):
            self._flush(len(self.rest))
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, np.int64)
        starts = len(MAGIC) + np.cumsum(sizes) - sizes
        footer = np.array(self.docs, "<i8").tobytes() + np.array(self.counts, "<u8").tobytes() + starts.astype("<u8").tobytes()
        self.out.write(footer + _TAIL.pack(len(self.docs), len(starts), self.total, len(footer), MAGIC))


class Reader:
    """One file's documents and ids."""

    def __init__(self, data: bytes):
        docs, blocks, self.total, size, magic = _TAIL.unpack(data[-_TAIL.size :])
        if magic != MAGIC or data[:4] != MAGIC:
            raise ValueError("not a token file")
        at = len(data) - _TAIL.size - size
        self.data = data
        self.docs = np.frombuffer(data, "<i8", docs, at)
        self.counts = np.frombuffer(data, "<u8", docs, at + 8 * docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks, at + 16 * docs).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1, from the blocks that hold them."""
        lo = first // BLOCK
        got = unpack(self.data, self.starts[lo : -(-last // BLOCK)])
        return got[first - lo * BLOCK : last - lo * BLOCK]
