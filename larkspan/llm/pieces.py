"""Operator 8, SentencePiece encoding and decoding for merge-type vocabularies.

Text is cut where no piece can reach across, and each distinct chunk is encoded by its agenda of adjacent symbol pairs: the pair whose piece has the best score,
the leftmost of equals, is merged, until no pair is a piece. Many short chunks run in step in numpy; a long one has a heap of its own. New chunks are checked against
the sentencepiece library batch by batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm import words as W
from larkspan.llm.shared import remembered

SPACE = "▁"
LONG = 192  # symbols from which a chunk gets a heap
CACHE = 400_000  # chunks that each of two generations of a worker's memory holds
LEAN, LEAN_BYTES = 100_000, 1 << 19  # the same for encode(), and its slices of texts: it also runs beside what earlier stages have left in an executor
_NONE = np.int64(1) << 30


class Agenda:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes, most: int = CACHE):
        self.most = most
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.n, self.end, self.unknown = n, lib.eos_id(), lib.unk_id()
        symbol = {names[i]: i for i in plain}
        for c in sorted({c for i in plain for c in names[i]} - symbol.keys()):
            symbol[c] = n + len(symbol)  # a character that is only part of pieces
        self.width = max(symbol.values()) + 1
        self.symbols = symbol
        # characters outside all pieces are symbols of their own, which join no pair
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.width
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = sorted({lib.get_score(i) for i in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        pairs = {}
        for i in plain:
            p = names[i]
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (rank[lib.get_score(i)], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [_NONE], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int64)
        self.byte = {b: lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)} if any(map(lib.is_byte, range(n))) else {}
        self.plain = set(plain)
        self.ids = [str(i) for i in range(n)]
        self.bytes_of = {str(i): names[i].replace(SPACE, " ").encode() for i in plain}
        self.bytes_of |= {str(i): b"" for i in range(n) if lib.is_control(i)}
        self.bytes_of |= {str(i): bytes([b]) for b, i in self.byte.items()}
        self.bytes_of[str(self.unknown)] = " ⁇ ".encode()
        self.byte_ids = {str(i) for i in self.byte.values()}
        # a chunk is a run of spaces with what follows; line ends stand alone unless some piece holds one
        inner = {c for i in plain for c in names[i]}
        crossing = any(a != SPACE and b == SPACE for i in plain for a, b in zip(names[i], names[i][1:], strict=False))
        ends = "" if "\n" in inner else "\n"
        self.chunk = re.compile(".+" if crossing else f"{SPACE}*[^{SPACE}{ends}]+|{SPACE}+" + ("|\n" if ends else ""), re.S)
        self.known: dict[str, str] = {}  # the newer generation
        self.older: dict[str, str] = {}

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; _NONE where the pair is no piece."""
        key = np.where((left < self.width) & (right < self.width), left * self.width + right, -1)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else at
        return self.ranks[at], self.made[at]

    def _in_step(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk number and symbol of the final symbols, in order; every round takes the head of each chunk's agenda."""
        sym = self.of_char[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        seg = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inside = np.flatnonzero(seg[:-1] == seg[1:])
        rank[inside], made[inside] = self._look(sym[inside], sym[inside + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(sym)), first)
            live = (best >> 32) < _NONE
            if not live.all():
                over = np.repeat(~live, np.diff(np.append(first, len(sym))))
                done.append((seg[over], sym[over]))
                keep = ~over
                if not keep.any():
                    break
                place = np.cumsum(keep) - 1
                at = place[best[live] & 0xFFFFFFFF]
                sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            else:
                at = best & 0xFFFFFFFF
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            sym, seg, rank, made, at = sym[keep], seg[keep], rank[keep], made[keep], place[at]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(sym))
                own = left[ok]
                same = seg[own] == seg[own + 1]
                r, m = self._look(sym[own], sym[own + 1])
                rank[own], made[own] = np.where(same, r, _NONE), m
                tail = left[(left >= 0) & (left + 1 >= len(sym))]
                rank[tail] = _NONE
        seg, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(seg, kind="stable")
        return seg[order], sym[order]

    def _by_heap(self, chunk: str) -> list[int]:
        """Final symbols of one chunk."""
        sym = [int(self.of_char[ord(c)]) for c in chunk]
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if i >= 0 and j < n and sym[i] < self.width and sym[j] < self.width and (p := self.pairs.get(sym[i] * self.width + sym[j])):
                heapq.heappush(agenda, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, a, b, new = heapq.heappop(agenda)
            j = after[i] if sym[i] == a else n
            if j >= n or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in sym if s >= 0]

    def _written(self, symbols: list[int]) -> str:
        """Ids of final symbols, joined by spaces; what is no piece goes byte by byte."""
        n, ids = self.n, self.ids
        if max(symbols) < n:
            return " ".join([ids[s] for s in symbols])
        out: list[str] = []
        chars = {i: s for s, i in self.symbols.items() if i >= n} if any(n <= s < self.width for s in symbols) else {}
        for s in symbols:
            if s < n:
                out.append(ids[s])
            else:
                c = chars[s] if s < self.width else chr(s - self.width)
                out += [ids[self.byte[b]] for b in c.encode()] if self.byte else [ids[self.unknown]]
        return " ".join(out)

    def learn(self, chunks: list[str], check: bool = True) -> dict[str, str]:
        """Ids of distinct chunks, joined by spaces."""
        symbols: list[list[int]] = []
        short, long = [c for c in chunks if len(c) < LONG], [c for c in chunks if len(c) >= LONG]
        for lo in range(0, len(short), 20_000):
            part = short[lo : lo + 20_000]
            seg, sym = self._in_step(part)
            bounds, flat = np.searchsorted(seg, np.arange(len(part) + 1)).tolist(), sym.tolist()
            symbols += [flat[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        symbols += [self._by_heap(c) for c in long]
        n, ids = self.n, self.ids
        out = [" ".join([ids[s] for s in x]) if max(x) < n else self._written(x) for x in symbols]
        if check and (wrong := self.differing(short + long, symbols, out)):
            raise ValueError(f"the agenda and the library differ on {wrong[:3]}")
        return dict(zip(short + long, out, strict=True))

    def differing(self, chunks: list[str], symbols: list[list[int]], out: list[str]) -> list[str]:
        """Chunks that the library encodes otherwise. It puts a space first, so chunks without one are given after a line end."""
        head = self.library.encode("\n")
        told = self.library.encode([c[1:] if c[0] == SPACE and len(c) > 1 else "\n" + c for c in chunks], num_threads=1)
        wrong = []
        for c, mine, text, x in zip(chunks, symbols, out, told, strict=True):
            if mine != x:  # plain pieces after a space are equal as they are
                if c[0] != SPACE or len(c) == 1:
                    x = x[len(head) :]
                if text != " ".join(map(str, x)):
                    wrong.append(c)
        return wrong

    def encode(self, texts: list[str], check: bool = True) -> list[str]:
        """Ids of each text with the end id, joined by spaces."""
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        cut = [self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        known, older = self.known, self.older
        got = [list(map(known.get, chunks)) for chunks in cut]
        open_texts = [i for i, x in enumerate(got) if None in x]
        if open_texts:
            lack = {c for i in open_texts for c, x in zip(cut[i], got[i], strict=True) if x is None}
            again = {c: older[c] for c in lack if c in older}
            known |= again
            known |= self.learn([c for c in lack if c not in again], check)
            for i in open_texts:
                got[i] = [known[c] if x is None else x for c, x in zip(cut[i], got[i], strict=True)]
        end = str(self.end)
        return [" ".join([*x, end]) for x in got]

    def decode(self, ids: str) -> str:
        """Text of ids joined by spaces: bytes run together, one first space goes, a byte that is part of no character becomes U+FFFD."""
        parts = ids.split(" ") if ids else []
        raw = b"".join([self.bytes_of[i] for i in parts])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._mended(parts)
        first = next((i for i in parts if self.bytes_of[i]), None)
        return text[1:] if first is not None and first not in self.byte_ids and text.startswith(" ") and first != str(self.unknown) else text

    def _mended(self, parts: list[str]) -> str:
        out, run = [], b""
        for i in [*parts, None]:
            if i in self.byte_ids:
                run += self.bytes_of[i]
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run = b""
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


def agenda(model: bytes, most: int = CACHE) -> Agenda:
    """The worker's own encoder, kept between tasks. Its two generations hold ``most`` chunks each, and those of one slice more."""
    return remembered(f"agenda {most} {hashlib.sha256(model).hexdigest()}", lambda: Agenda(model, most))


def _cuts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    _, offset = W.buffers(column)
    for lo, hi in W.cuts(offset, size):
        yield lo, column.slice(lo, hi - lo).fill_null("").to_pylist()


def encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", check: bool = True) -> DataFrame:
    """``docs`` with ids_col, an array of ints ending in the end id (it replaces a column of that name). A null text counts as empty: only the end id.

    Each text is encoded whole. An empty table gives an empty one.
    """
    held = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    base = docs.drop(ids_col) if ids_col != text_col else docs
    names = {c: f"__c{i}" for i, c in enumerate(base.columns)}
    frame = base.toDF(*names.values())
    kinds = dict(frame.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(held.value, LEAN)
        for batch in batches:
            for lo, texts in _cuts(batch.column(names[text_col]), LEAN_BYTES):
                ids = [np.array(x.split(" "), np.int32) for x in own.encode(texts, check)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, len(texts)) for c in batch.columns), lists], [*names.values(), "__ids"])

    out = frame.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names.values()), "__ids array<int>"]))
    return out.toDF(*base.columns, ids_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with text_col, the text of the array in ids_col; a null array gives a null."""
    held = rows.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())

    @F.pandas_udf("string")
    def run(x):
        own = agenda(held.value)
        return x.map(lambda v: None if v is None else own.decode(" ".join(map(str, v))))

    return rows.withColumn(text_col, run(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """One row for each input row: id_col, n_tokens, ids_sha256, decoded_sha256 of the round trip. Rules as in encode()."""
    held = docs.sparkSession.sparkContext.broadcast(open(model_path, "rb").read())
    frame = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = dict(frame.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(held.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for lo, texts in _cuts(batch.column("text")):
                ids = own.encode(texts, check)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, len(texts)), pa.array([x.count(" ") + 1 for x in ids], pa.int64()), pa.array([sha(x.encode()) for x in ids]), pa.array([sha(own.decode(x).encode()) for x in ids])], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return frame.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
