"""Small corpora with copies, near copies, empty and null texts, repeated rows and columns whose names clash with made ones."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, shard int"


def corpus(n=60, seed=4):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(1, 6))) for _ in range(160)]
    text = lambda k: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", ". ", "  "]) for _ in range(k))
    passage = text(70)
    texts = []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.2:
            texts.append(rnd.choice(texts))
        elif texts and kind < 0.45:
            old = rnd.choice(texts).split(" ")
            for _ in range(max(1, len(old) // 60)):
                old[rnd.randrange(len(old))] = rnd.choice(words)
            texts.append(" ".join(old))
        elif kind < 0.6:
            texts.append(text(rnd.randint(5, 80)) + passage + text(rnd.randint(0, 80)))
        else:
            texts.append(text(rnd.choice([1, 3, 20, 60, 150, 400])))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, texts[0]), (3, texts[3]), (None, texts[5]), (n + 4, "Ünïcode 😀 　 漢字 " * 30), (n + 5, "a " * 5000)]
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["s0", "s0", "s1"]), None if t is None else len(t), 7, True, 3) for i, t in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
