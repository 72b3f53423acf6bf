import random
import re

import numpy as np
import pytest

from emberlog.llm import minhash as m
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(width)]))


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (doc, *_) in enumerate(rows):
        ids = [x for x in (least.get(root(i)), doc) if x is not None]
        least[root(i)] = min(ids, default=None)
    return sorted(((doc, len(sets[i]), least[root(i)]) for i, (doc, *_) in enumerate(rows)), key=repr)


def check(spark, rows, width=3, num=85, den=100):
    got = m.near_dedup(documents(spark, rows), width=width, num=num, den=den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows, width, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def drifting(seed, n, words, changes):
    """A chain of texts, each a few words away from one before it."""
    rng = random.Random(seed)
    texts = [[rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(words)]]
    while len(texts) < n:
        t = list(rng.choice(texts[-5:]))
        for _ in range(changes):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10_000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows)


@pytest.mark.parametrize("shingles", [1 << 17, 300])
def test_chains_and_families(spark, monkeypatch, shingles):
    # Small blocks cut families into many tiles.
    monkeypatch.setattr(m, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(m, "COLUMNS", 50)
    texts = drifting(1, 30, 120, 2) + drifting(2, 25, 60, 3) + drifting(3, 12, 7, 1)
    check(spark, [(i * 3 % 1000, t, None, None) for i, t in enumerate(texts)])


def test_five_words(spark):
    check(spark, [(i, t, None, None) for i, t in enumerate(drifting(4, 30, 100, 2))], 5, 80, 100)


def test_empty_table(spark):
    got = m.near_dedup(documents(spark, []))
    assert got.count() == 0
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_forest_connects_what_is_linked():
    rng = np.random.default_rng(1)
    for same in (True, False):
        for _ in range(30):
            linked = rng.random((12, 12 if same else 9)) < 0.12
            linked = linked | linked.T if same else linked
            links = m.forest(linked, same)

            def groups(pairs):
                label = {}
                for x, y in pairs:
                    x, y = ("x", x), ("x" if same else "y", y)
                    old, new = label.setdefault(x, x), label.setdefault(y, y)
                    label = {k: new if v == old else v for k, v in label.items()}
                return {frozenset(k for k in label if label[k] == v) for v in label.values()}

            every = [tuple(p) for p in np.argwhere(linked) if not same or p[0] != p[1]]
            assert groups(links) == groups(every)


def test_more_keys_for_lower_similarity():
    assert m.collections_for(0.8) > m.collections_for(0.85)


def test_short_texts_with_a_common_start(spark, monkeypatch):
    """Many classes of few shingles: below the size that can be linked they are not compared, above it blocks hold a few."""
    check(spark, [(i, f"order was shipped w{i}", None, None) for i in range(300)])
    monkeypatch.setattr(m, "BLOCK_CLASSES", 16)
    rows = [(i, f"this order of yours was shipped to you early today as announced in w{i % 90}", None, None) for i in range(200)]
    check(spark, rows)
    check(spark, rows, 3, 70, 100)


def test_blocks_are_bounded_by_classes(spark):
    entries = spark.range(9_000).selectExpr("1L as _bucket", "id as cid", "2L as _n")
    sizes = [r["count"] for r in m._blocks(entries).groupBy("block").count().collect()]
    assert sum(sizes) == 9_000 and len(sizes) == 5 and max(sizes) < 1.3 * m.BLOCK_CLASSES


@pytest.mark.parametrize("num", [60, 85])
def test_sets_below_the_cut_have_no_partner(num):
    """The most similar of different sets share all of the smaller one and differ by one shingle."""
    for n in range(1, 30):
        possible = any(100 * n >= num * (n + more) for more in (1, 2, 3))
        assert possible == (n * 100 >= (n + 1) * num)
