"""Operator 2, token ids in patched frame-of-reference files, in ascending id order over all files."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspan.llm import pfor
from larkspan.llm import words as W
from larkspan.llm.shared import cut, partitions, shared_dir

CACHE = 150_000  # words that each of two generations of a worker's memory holds
# letters whose lower case and composition no neighbour changes, and marks that stand apart from them
_SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|]*)")


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself, or the next one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Memory:
    """A dictionary of two generations: when the newer is full it becomes the older, and the older goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def turn(self) -> dict:
        if len(self.new) > self.most:
            self.new, self.old = {}, self.new
        return self.new


class Encoder:
    """Ids of texts by the tokenizers library. White space separates tokens, so each distinct word is encoded once and remembered by its hash.

    A word of plain letters, with or without marks after it, goes straight to the library's BPE model, as the vocabulary's normaliser and splitter would only lower it
    and cut off the marks; any other word goes through the whole library.
    """

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.by_word = all(x in repr(self.library.normalizer) for x in ("NFC", "Lowercase")) and "invert=True" in repr(self.library.pre_tokenizer) and "ByteLevel" in repr(self.library.pre_tokenizer)
        self.model, self.letters = self.library.model, _byte_letters()
        self.words, self.atoms, self.tails = Memory(CACHE), Memory(CACHE), {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self._library([marks])[0]
        return self.tails[marks]

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words: the atoms of plain ones are looked up in lower case."""
        atoms, old = self.atoms.turn(), self.atoms.old
        tokenize, letters = self.model.tokenize, self.letters
        out: list[bytes | None] = []
        slow = []
        for w in words:
            tail = None
            if w.isalpha():  # ASCII letters
                key = w.lower()
            elif w[-1] in b".,|" and w[:-1].isalpha():
                key, tail = w[:-1].lower(), chr(w[-1])
            elif m := _SIMPLE.fullmatch(w.decode()):
                key, tail = m[1].lower().encode(), m[2]
            else:
                slow.append(w)
                out.append(None)
                continue
            v = atoms.get(key)
            if v is None:
                v = old.get(key)
                if v is None:
                    raw = key.decode() if key.isascii() else key.decode("latin-1").translate(letters)
                    v = array("I", [t.id for t in tokenize(raw)]).tobytes()
                atoms[key] = v
            out.append(v + self._tail(tail) if tail else v)
        rest = iter(self._library([w.decode() for w in slow]))
        return [next(rest) if v is None else v for v in out]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each slice of a column of texts: its first row, the ids end to end, and how many each text has."""
        data, offset = W.buffers(column)
        for lo, hi in W.cuts(offset, 2 << 20 if self.by_word else 1 << 20):
            if not self.by_word:
                found = self._library(column.slice(lo, hi - lo).fill_null("").to_pylist())
                yield lo, np.frombuffer(b"".join(found), "<u4"), np.array([len(v) // 4 for v in found], np.int64)
                continue
            x = W.split(data[offset[lo] : offset[hi]], offset[lo : hi + 1] - offset[lo], W.BLANK, False, lo)
            code, distinct = pd.factorize(x.hash)
            keys = distinct.tolist()
            known, old = self.words.turn(), self.words.old
            got = list(map(known.get, keys))
            lack = [i for i, v in enumerate(got) if v is None]
            if lack:
                place = np.empty(len(keys), np.int64)
                place[code[::-1]] = np.arange(len(code) - 1, -1, -1)
                raw, start, end = x.data.tobytes(), x.start[place].tolist(), x.end[place].tolist()
                fresh = []
                for i in lack:
                    v = old.get(keys[i])
                    if v is None:
                        fresh.append(i)
                    else:
                        got[i] = known[keys[i]] = v
                for i, v in zip(fresh, self._learn([raw[start[i] : end[i]] for i in fresh]), strict=True):
                    got[i] = known[keys[i]] = v
            size = np.fromiter(map(len, got), np.int64, len(got)) >> 2
            pool, first = np.frombuffer(b"".join(got), "<u4"), np.cumsum(size) - size
            n = size[code]
            ends = np.concatenate([[0], np.cumsum(n)])
            ids = pool[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
            yield lo, ids, np.diff(ends[x.first])

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for _, ids, n in self.encode(pa.array(texts, pa.string())):
            out += np.split(ids, np.cumsum(n)[:-1])
        return out


def _ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids with end_id after each text's."""
    return np.insert(ids, np.cumsum(counts), end_id)


_held: dict[int, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _held:
        _held[key] = Encoder(spec)
    return _held[key]


def _target(directory: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(directory) if "://" in directory or directory.startswith("file:") else (pyarrow.fs.LocalFileSystem(), directory)


def write(docs: DataFrame, tokenizer_path: str, end_id: int, directory: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """Write every text's ids, each followed by end_id, in ascending id order; returns the folder and rows (part, n_docs, n_tokens).

    A null text counts as empty, a null id sorts first and is written as the least long. Rows are range-partitioned and sorted by id, text breaking ties, and each task writes one
    file under a name of its own attempt before it moves it to its final name, so a repeated task leaves the same file. The folder must be one that all
    executors share.
    """
    spark = docs.sparkSession
    directory = directory or shared_dir(spark)
    held = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    frame = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = frame.repartitionByRange(partitions(spark), "id", tie).sortWithinPartitions("id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = _encoder(held.value)
        fs, root = _target(directory)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.lpf"
        temporary = f"{root}/_attempt-{task.partitionId():06d}-{task.taskAttemptId()}"
        n_docs = n_tokens = 0
        with fs.open_output_stream(temporary) as out:
            writer = pfor.Writer(out)
            for batch in batches:
                for lo, found, counts in own.encode(batch.column("text")):
                    writer.add(batch.column("id").slice(lo, len(counts)).to_pylist(), (counts + 1).tolist(), _ended(found, counts, end_id))
            writer.close()
            n_docs, n_tokens = len(writer.docs), writer.total
        fs.move(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], ["part", "n_docs", "n_tokens"])

    return directory, cut(rows.mapInArrow(run, "part int, n_docs long, n_tokens long"))


def read(spark: SparkSession, directory: str, manifest: DataFrame, ids: bool = False) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32, and ids if asked for) of the files of write(), one for each document.

    start counts the ids of all documents before; the manifest, of one row for each file, is summed for that.
    """
    more = [("ids", "array<long>")] if ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = int(re.search(r"part-(\d+)\.lpf$", path)[1])
                file = pfor.Reader(data)
                bounds = np.concatenate([[0], np.cumsum(file.counts)])
                step = 4096
                for lo in range(0, len(file.docs), step):
                    hi = min(lo + step, len(file.docs))
                    got = file.ids(int(bounds[lo]), int(bounds[hi])).astype("<u4")
                    at = (bounds[lo : hi + 1] - bounds[lo]).tolist()
                    view = memoryview(got).cast("B")
                    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at, at[1:], strict=False)]
                    cols = [pa.array(np.full(hi - lo, part, np.int32)), pa.array(file.docs[lo:hi]), pa.array(bounds[lo:hi]), pa.array(file.counts[lo:hi]), pa.array(crc, pa.int64())]
                    lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(got.astype(np.int64)))] if ids else []
                    yield pa.RecordBatch.from_arrays([*cols, *lists], ["part", "id", "at", "n_tokens", "ids_crc32", *(n for n, _ in more)])

    if manifest.isEmpty():  # an empty table has no tasks, so there is no folder
        return spark.createDataFrame([], ", ".join(["id long, start long, n_tokens long, ids_crc32 long", *(f"{n} {k}" for n, k in more)]))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.lpf").load(directory).select("path", "content")
    rows = files.mapInArrow(run, ", ".join(["part int, id long, at long, n_tokens long, ids_crc32 long", *(f"{n} {k}" for n, k in more)]))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("part", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0)).alias("before"))  # one row for each file
    found = rows.join(F.broadcast(starts), "part")
    return found.select(F.nullif("id", F.lit(-(1 << 63))).alias("id"), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(n for n, _ in more))


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as token files and read them back: id_col, start, n_tokens, ids_crc32, one row for each input row; an empty table gives none."""
    directory, manifest = write(docs, tokenizer_path, end_id, None, id_col, text_col)
    return read(docs.sparkSession, directory, manifest).withColumnRenamed("id", id_col)
