"""Operators 11 to 13 against brute-force versions: nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspan.llm import byte_dedup, collocations, filter_audit, suffix_sort

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11


def _audit_brute(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    docs = []
    for i, t, source in rows:
        t = t or ""
        w = BLANK.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        docs.append((source or "", {k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        sums = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                sums[f] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(sums[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_of_all_orders(spark, docs, rows, empty):
    rnd = random.Random(3)
    more = [(900 + i, " ".join(rnd.choice(["Ab", "cd", "e#f", "gh", "IJ", "kl|", "m"]) + str(rnd.randrange(n)) for _ in range(rnd.choice([10, 60, 80]))), None, rnd.choice(["s0", None, "s2"]), 1, 1, True, 1) for i, n in enumerate([3, 30, 4000] * 15)]
    more += [(None, more[0][1], None, "s0", 1, 1, True, 1), (899, more[1][1], None, "s2", 1, 1, True, 1), (901, more[1][1], None, "s0", 1, 1, True, 1), (990, None, None, "s2", 1, 1, True, 1)]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 990, 3)] + [(None, 1, 1), (900, 0, 1), (900, 1, None), (77777, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("source", F.lit("clash"))
    got = filter_audit.audit(filter_audit.masks(every, labels), list("ABCDE"))
    expected = _audit_brute([(i, t, s) for i, t, _, s, *_ in rows + more], marks)
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r.part, r.filter_order, r.step): tuple(r[c] for c in cols) for r in got.collect()} == expected
    assert len({v[:4] for v in expected.values()}) > 20  # the case is a varied one
    assert filter_audit.audit(filter_audit.masks(empty, labels), list("ABCDE")).count() == 0
    assert [t for c, t in got.dtypes if c in cols] == ["bigint"] * 7


def test_signed_sums_give_back_every_cell(spark):
    rnd = random.Random(5)
    given = [("p", rnd.random() < 0.5, False, rnd.choice([0, 0, 0, 3, 5, 7, 8, 15])) for _ in range(500)]
    got = {(r.part, r.good, r.toxic): r.n for r in filter_audit.cells(spark.createDataFrame(given, "part string, good boolean, toxic boolean, mask int"), 4).collect()}
    counts = Counter(given)
    assert got == {("p", g, False): [counts["p", g, False, m] for m in range(16)] for g in (True, False)}
    with pytest.raises(ValueError):
        filter_audit.audit(None, list("ABCDEFG"))


# 12


def _bytes_brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[p : p + span] for r in raw for p in range(len(r) - span + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - span + 1):
            if count[r[p : p + span]] > 1:
                gone[p : p + span] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


COLS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize(("span", "k", "most"), [(200, 64, 64), (200, 64, 1), (24, 8, 64), (24, 8, 1)])  # at 1, every anchor's contexts are cut down
def test_repeated_bytes(docs, rows, empty, span, k, most, monkeypatch):
    monkeypatch.setattr(byte_dedup, "MANY", most)
    monkeypatch.setattr(byte_dedup, "SHARD_CONTEXTS", 40)
    got = Counter((r.doc_id, *(r[c] for c in COLS)) for r in byte_dedup.dedup(docs, span=span, k=k).collect())
    told = _bytes_brute([t for _, t, *_ in rows], span)
    assert got == Counter((r[0], *x) for r, x in zip(rows, told, strict=True))
    assert len({x[1] for x in told}) > 3
    assert byte_dedup.dedup(empty).count() == 0


def test_hostile_bytes(spark, monkeypatch):
    """A long text in parts, one of one character, periods, a family of many near copies, and real spans and bytes."""
    monkeypatch.setattr(byte_dedup, "_chunks", lambda d, o, span, most=3000, f=byte_dedup._chunks: f(d, o, span, most))
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefé漢") for _ in range(rnd.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = text(90)
    texts = [text(4000) + base + text(2000), "x" * 7000, "ab" * 500, "y" * 200, "y" * 199, "q" * 201, base, base[3:] + base, None, "", "漢" * 100, text(50) + base[:150]]
    for i in range(150):
        w = base.split()
        w[rnd.randrange(90)] = f"{i}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "key int, body string").withColumn("text", F.lit("clash")).repartition(3)
    got = {r.key: r for r in byte_dedup.dedup(df, "key", "body", spans=True, kept=True).collect()}
    told = _bytes_brute(texts, 200)
    assert [tuple(got[i][c] for c in COLS) for i in range(len(texts))] == told
    for i, t in enumerate(texts):
        raw, r = (t or "").encode(), got[i]
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == told[i][3] and sum(s.hi - s.lo for s in r.spans) == told[i][1]
        assert b"".join(raw[s.lo : s.hi] for s in r.spans) == bytes(b for p, b in enumerate(raw) if any(s.lo <= p < s.hi for s in r.spans))


def test_suffixes_sort_as_their_bytes_do():
    rnd = np.random.default_rng(2)
    for letters, n, limit in ((2, 400, 9), (4, 900, 20), (1, 60, 8)):
        data = rnd.integers(97, 97 + letters, n + limit).astype(np.uint8)
        at = rnd.permutation(n)
        group = rnd.integers(0, 5, n)
        text = suffix_sort.HashedText(data, limit)
        key = lambda i: (group[i], data[at[i] : at[i] + limit].tobytes())
        order = suffix_sort.sort_suffixes(text, at, group)
        assert [key(i) for i in order] == sorted(key(i) for i in range(n))
        counts = Counter(key(i) for i in range(n))
        assert suffix_sort.repeated_suffixes(text, at, group).tolist() == [counts[key(i)] > 1 for i in range(n)]


def test_collisions_of_hashes_are_found(monkeypatch):
    data = np.frombuffer(b"abcdabceabcdxyzwxyzw", np.uint8)
    text = suffix_sort.HashedText(data, 4)
    at = np.array([0, 4, 8, 12, 16])
    monkeypatch.setattr(text, "span", lambda a, n: np.zeros(len(a), np.uint64))  # every span collides
    assert suffix_sort.repeated_suffixes(text, at, np.zeros(5, np.int64)).tolist() == [True, False, True, True, True]


# 13


def _phrases_brute(rows, max_n, least, cover, top):
    f, n = defaultdict(Counter), Counter()
    for t, lang in rows:
        for p in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", p)
            n[lang or "und"] += len(w)
            for k in range(1, max_n + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: B023, E731
            if any(inside(q) and 100 * b >= cover * a for q, b in cand.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return out


@pytest.mark.parametrize(("max_n", "least", "cover", "top"), [(3, 10, 50, 2000), (3, 3, 50, 25), (4, 2, 70, 400), (2, 5, 50, 2000)])
def test_phrases(spark, docs, rows, empty, max_n, least, cover, top):
    rnd = random.Random(6)
    pool = ["New York city", "new york CITY hall", "the", "of", "in fact,", "à la carte.", "À La", "x;y", "\t", "漢 字 漢", "a a a a", "one two three\r\n", "!"]
    more = [(1000 + i, " ".join(rnd.choice(pool) for _ in range(rnd.choice([1, 30, 200]))), rnd.choice(["en", None, "und", "fr"]), "s", 1, 1, True, 1) for i in range(50)] + [(1, "one two " * 30000, "xx", "s", 1, 1, True, 1)]
    every = docs.union(spark.createDataFrame(more, docs.schema))
    got = collocations.mine(every, max_n, least, cover, top)
    expected = _phrases_brute([(t, lang) for _, t, lang, *_ in rows + more], max_n, least, cover, top)
    assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()} == expected
    assert len(expected) > 20
    assert collocations.mine(empty).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    """10**6 * a * a passes 64 bits, and the floors differ from what doubles give."""
    a, left, right = 94_906_267, 94_906_268, 94_906_269
    d = lambda v: F.lit(v).cast("decimal(16,0)")
    got = spark.range(1).select((d(a) * d(a) * F.lit(10**6).cast("decimal(7,0)")).cast("decimal(38,0)").alias("t"), (d(left) * d(right)).alias("u")).selectExpr("cast(t div u as bigint) s").first().s
    assert got == 10**6 * a * a // (left * right)
