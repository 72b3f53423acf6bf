import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from emberlog.llm import importance as imp
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = ["a", "B", "9", " ", "-", "é", "漢", "word", "\n", "_", "x" * 70, "Y" * 300]


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("block", [1 << 20, 5, 17, 64])
def test_checksums_equal_zlib(monkeypatch, block):
    """Words of any length, cut by blocks of any size."""
    monkeypatch.setattr(imp, "BLOCK", block)
    rng, crc = random.Random(block), imp.Crc()
    for _ in range(15):
        texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 25))) for _ in range(12)]
        for longest in (1, 3):
            found, rows, counts = imp.buckets(crc, *arrays(texts), longest, 2**32 - 1)
            for i, t in enumerate(texts):
                assert sorted(found[rows == i].tolist()) == sorted(f % (2**32 - 1) for f in features(t, longest))
                assert counts[i] == len(words(t))


def test_a_word_of_megabytes():
    raw = "z" * 3_000_000 + " q"
    found, _, _ = imp.buckets(imp.Crc(), *arrays([raw]), 2, 10_000)
    assert sorted(found.tolist()) == sorted(f % 10_000 for f in features(raw, 2))


def brute(rows, targets, longest=1, count=10_000, least=20, percent=10):
    s, t = np.zeros(count, int), np.zeros(count, int)
    for texts, out in (([r[1] for r in rows], s), (targets, t)):
        for text in texts:
            for f in features(text, longest):
                out[f % count] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + count) / ((a + 1) * (t.sum() + count)))) for a, b in zip(s.tolist(), t.tolist())]
    scored = []
    for doc, text, *_ in rows:
        f = [gain[x % count] for x in features(text, longest)]
        weight = sum(f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        scored.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)), None])
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[:percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(((d, n, w, x, r) for d, n, w, x, _, r in scored), key=repr)


def check(spark, rows, targets, **options):
    target = spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "item_id long, text string")
    names = {"count": "count", "least": "min_words", "percent": "percent", "longest": "longest"}
    got = imp.resample(documents(spark, rows), target, **{names[k]: v for k, v in options.items()})
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 5
    assert sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr) == brute(rows, targets, **options)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "TARGET", "x-y"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))), "en", "a") for i in range(300)]
    check(spark, rows, ["target w1 w2", "w1 x y", None], percent=25)


def test_runs_of_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["a", "b", "C", "dd"], k=rng.randint(0, 9))), "en", "a") for i in range(60)]
    check(spark, rows, ["a b c", "dd dd"], longest=3, count=50, least=3, percent=50)


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows, ["quick brown fox", None, ""], least=1, percent=100)
    check(spark, odd_rows, [], least=0, percent=50)


def test_empty_tables(spark):
    check(spark, [], ["a"])
    check(spark, [], [])


def test_ranks_of_equal_rows_follow_each_other(spark):
    """A third of all rows under one id: no row is lost, and ranks have no gaps."""
    rows = [(7, "a b c d", "en", "a")] * 400 + [(i, f"a{i} b c d", "en", "a") for i in range(800)]
    check(spark, rows, ["b c"], least=1, percent=100)
