"""Sorting suffixes of a byte text by hashes: prefix polynomial hashes give the hash of any span, binary search over them the common extension of two suffixes,
and a bottom-up mergesort does with as few comparisons as any; equal ones are compared once more by their bytes."""

from __future__ import annotations

import numpy as np

from larkspan.llm import words as W


class HashedText:
    """A byte text and its prefix hashes modulo 2**64; spans are compared by them, up to ``limit`` bytes."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data, self.limit = data, limit
        self.sums = W.prefix(data.astype(W.U) + W.U(1), W.BYTES)
        self.back = W.BYTES.of(len(data) + 1)[1]

    def span(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of each span; equal bytes give equal hashes."""
        return (self.sums[at + length] - self.sums[at]) * self.back[at]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes, ``limit`` at most, the suffixes at a and b have in common, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.limit, np.int64)
        same = self.span(a, hi) == self.span(b, hi)  # mostly so; else the halves are searched
        lo[same] = self.limit
        left = np.flatnonzero(~same)
        lo_, hi_, a, b = lo[left], hi[left] - 1, a[left], b[left]
        while len(left) and (hi_ > lo_).any():
            mid = (lo_ + hi_ + 1) >> 1
            ok = self.span(a, mid) == self.span(b, mid)
            lo_, hi_ = np.where(ok, mid, lo_), np.where(ok, hi_, mid - 1)
        lo[left] = lo_
        return lo

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """True where the suffix at a sorts before the one at b (or they agree in ``limit`` bytes, if so asked)."""
        n = self.common(a, b)
        ends = n >= self.limit
        n = np.where(ends, 0, n)
        return np.where(ends, or_equal, self.data[a + n] < self.data[b + n])


def sort_suffixes(text: HashedText, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order of the suffixes at ``at`` by group, then by their first ``limit`` bytes, ties as they come.

    Groups are of few suffixes each and are sorted side by side: a round merges neighbouring runs of each group, where a suffix's new place is its
    place in its own run plus that in the other one, which is found by binary search; each of its steps is one comparison of all suffixes under way.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(g)))
    first, size_of = np.repeat(edge, size), np.repeat(size, size)
    place = np.arange(len(g)) - first  # within the group
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(size_of > width)  # those of groups that are one run already stay
        own = place[live] // width
        other = own ^ 1
        lo = np.minimum(other * width, size_of[live])
        begin, end = lo.copy(), np.minimum(lo + width, size_of[live])
        hi = end.copy()
        right = (own & 1) == 1  # of equal ones the left run's come first
        x = at[order[live]]
        while True:
            go = np.flatnonzero(lo < hi)
            if not len(go):
                break
            mid = (lo[go] + hi[go]) >> 1
            y = at[order[first[live][go] + mid]]
            before = np.empty(len(go), bool)
            r = right[go]
            before[r] = text.less(y[r], x[go][r], True)
            before[~r] = text.less(y[~r], x[go][~r], False)
            lo[go] = np.where(before, mid + 1, lo[go])
            hi[go] = np.where(before, hi[go], mid)
        target = first[live] + np.minimum(own, other) * width + (place[live] - own * width) + (lo - begin)
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2
    return order


def repeated_suffixes(text: HashedText, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """True for each suffix whose first ``limit`` bytes another suffix of its group has too.

    Neighbours of the sorted order are compared; those that agree by hash are compared by their bytes, and where hashes collide (found so) the group is sorted by its bytes instead.
    """
    order = sort_suffixes(text, at, group)
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    a, b = at[order[:-1]], at[order[1:]]
    pair = np.flatnonzero((group[order[:-1]] == group[order[1:]]) & (text.span(a, np.full(len(a), text.limit)) == text.span(b, np.full(len(b), text.limit))))
    step, wrong = max(1, (1 << 20) // text.limit), []
    reach = np.arange(text.limit)
    for i in range(0, len(pair), step):
        p = pair[i : i + step]
        equal = (text.data[a[p][:, None] + reach] == text.data[b[p][:, None] + reach]).all(1)
        out[order[p[equal]]] = out[order[p[equal] + 1]] = True
        wrong.extend(p[~equal].tolist())
    for g in {int(group[order[p]]) for p in wrong}:
        own = np.flatnonzero(group == g)
        seen: dict[bytes, list[int]] = {}
        for i in own.tolist():
            seen.setdefault(text.data[at[i] : at[i] + text.limit].tobytes(), []).append(i)
        out[own] = False
        for same in seen.values():
            out[same] = len(same) > 1
    return out
