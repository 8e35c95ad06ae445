"""A compressed FM-index over word ids: packed wavelet matrix of the Burrows-Wheeler transform, searched backwards for many patterns at once."""

from __future__ import annotations

import numpy as np

class WaveletMatrix:
    """Ranks of symbols in a sequence. Each level is a packed bit vector with a count for each 64 bits."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        n = len(seq)
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.words.append(words)
            self.ones.append(before)
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at`` of the sequence, plus the place where its run begins after the last level."""
        for i in range(self.levels):
            bit = (symbol >> (self.levels - 1 - i)) & 1
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[i][word] + np.bitwise_count(self.words[i][word] & below)
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return at


class FMIndex:
    """Index of a text of symbols from 0 to sigma - 1, where 0 ends a piece; each piece has an owner number. Suffixes are in full order, so patterns can have any length."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, sigma: int):
        n = len(text)
        bits = max(1, int(sigma).bit_length())
        width = max(1, 62 // bits)  # so many symbols are ordered at once, then twice as many each time, until all suffixes differ
        key = np.zeros(n, np.int64)
        for i in range(width):
            key <<= bits
            key[: n - i] += text[i:] + 1
        while True:
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.zeros(n, np.int64)
            new[1:] = s[1:] != s[:-1]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if width >= n or rank[order[-1]] == n - 1:
                break
            key = rank * (n + 1)
            key[: n - width] += rank[width:] + 1
            width *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.n, self.sigma = n, sigma
        self.bwt = WaveletMatrix(text[suffixes - 1], sigma)
        counts = np.bincount(text, minlength=sigma + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.run = self.bwt.rank(np.arange(sigma), np.zeros(sigma, np.int64))  # where each symbol's run begins after the last level
        self.least = [owner[suffixes].astype(np.int32)]  # sparse table of range minima
        while 1 << len(self.least) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern, given those of the patterns."""
        both = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.first[symbol] - self.run[symbol]
        m = len(symbol)
        return both[:m] + start, both[m:] + start

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least owner in each interval; the largest number for an empty one."""
        out = np.full(len(lo), np.iinfo(np.int32).max, np.int64)
        ok = np.flatnonzero(hi > lo)
        level = np.frexp((hi[ok] - lo[ok]).astype(float))[1] - 1
        for v in np.unique(level):
            own = ok[level == v]
            table = self.least[v]
            out[own] = np.minimum(table[lo[own]], table[hi[own] - (1 << int(v))])
        return out


def earlier_matches(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, span: int, probe: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal intervals of at least ``span`` symbols that also stand in a piece of a lesser owner: (piece, first, end), places in ``text``.

    All pieces are searched in step. From a right end a piece's match grows leftwards while some lesser owner has it: that is its matching
    statistic. Where it stops, the first ``probe`` symbols from there are tried alone: if no lesser owner has them, nothing further left can match.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(end - begin >= span)
    right, at = end[live].copy(), end[live].copy()  # the match under way is [at, right)
    stop = np.full(len(live), -1)  # while a probe is under way: the place it must reach
    back = np.zeros(len(live), np.int64)  # the right end to go on with after a probe
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), index.n)
    while len(live):
        next_lo, next_hi = index.extend(text[at - 1], lo, hi)
        good = index.least_owner(next_lo, next_hi) < owner[live]
        lo, hi, at = np.where(good, next_lo, lo), np.where(good, next_hi, hi), np.where(good, at - 1, at)
        left = begin[live]
        probing = stop >= 0
        whole = good & ~probing & (at == left)
        broke = ~good & ~probing
        ended = whole | broke
        long = ended & (right - at >= span)
        if long.any():
            found.append((live[long], at[long].copy(), right[long].copy()))
        done = whole | (probing & ~good)
        # a match ended at ``at``: windows that hold [at - 1, right) are out; the next right end is below both right and at - 1 + span
        nxt = np.minimum(right - 1, at - 1 + span)
        done |= broke & (nxt - left < span)
        ask = broke & ~done
        probe_end = np.minimum(at - 1 + probe, nxt)
        useful = ask & (probe_end - left <= span) & (probe_end > at - 1)  # every window still possible holds the probe, which isn't empty
        back = np.where(ask, nxt, back)
        stop = np.where(useful, at - 1, np.where(ask, -1, stop))
        restart = np.where(useful, probe_end, nxt)
        passed = probing & good & (at == stop)
        restart = np.where(passed, back, restart)
        stop = np.where(passed, -1, stop)
        again = ask | passed
        right, at = np.where(again, restart, right), np.where(again, restart, at)
        lo, hi = np.where(again, 0, lo), np.where(again, index.n, hi)
        live, right, at, stop, back, lo, hi = (x[~done] for x in (live, right, at, stop, back, lo, hi))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
