import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import ann as m
from emberlog.llm.common import table
from tests.oracle import TESTDATA


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, rid string, score int")


def brute(rows, k):
    """Exact neighbours of the rows whose id is a multiple of 20."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    out = {}
    for line, i in enumerate(ids):
        if i % 20 == 0:
            order = sorted((-sum(a * b for a, b in zip(x[line], x[j])), ids[j]) for j in range(len(ids)) if j != line)
            out[i] = [(i2, pytest.approx(-s, abs=1e-12)) for s, i2 in order[:k]]
    return out


def search(spark, rows, **settings):
    got = m.search(vectors(spark, rows), F.col("vec_id") % 20 == 0, **settings).orderBy("query_id", "rank").collect()
    out = {}
    for r in got:
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_full_coverage_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "PACK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(150)] + [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(60)]
    assert search(spark, rows, k=5, coverage=1.0) == brute(rows, 5)


def test_odd_vectors_take_no_part(spark):
    good = [(i, [float(i % 7), 1.0, -float(i)]) for i in range(0, 100, 10)]
    bad = [(400, None), (420, []), (440, [0.0, 0.0, 0.0]), (460, [1.0, None, 2.0]), (480, [math.nan, 1.0, 1.0]), (500, [math.inf, 1.0, 1.0]),
           (520, [1.0, 2.0])]
    assert search(spark, good + bad, k=20) == brute(good, 20)


def test_one_row_and_no_row(spark):
    assert search(spark, [(0, [1.0, 2.0])]) == {}
    empty = m.search(vectors(spark, [(0, None)]), F.col("vec_id") % 20 == 0)
    assert empty.count() == 0
    assert empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_recall(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, f"{TESTDATA}/sf0.001", "embeddings").collect()]
    exact, got = brute(rows, 20), search(spark, rows)
    hit = sum(len({i for i, _ in exact[q]} & {i for i, _ in got[q]}) for q in exact)
    assert hit >= 0.9 * sum(map(len, exact.values()))
    assert all(len(v) == 20 for v in got.values())


def test_walk_meets_cells_in_order():
    index = m.MultiIndex(np.array([[1.0], [2.0], [3.0]]), np.array([[1.0], [5.0]]))
    counts = np.ones((3, 2), dtype=int)
    # Sums for (1, 1): 3+5, 2+5, 1+5, 3+1, 2+1, 1+1.
    order = [(2, 1), (1, 1), (0, 1), (2, 0), (1, 0), (0, 0)]
    for n in range(1, 7):
        a, b = index.visit(np.array([1.0, 1.0]), counts, n)
        assert list(zip(a, b)) == order[:n]
        assert index.needed(np.array([1.0, 1.0]), counts, a, b).tolist() == list(range(1, n + 1))
    counts[1, 1] = 0
    assert list(zip(*index.visit(np.array([1.0, 1.0]), counts, 2))) == [(2, 1), (0, 1)]


def test_blocks_hold_every_cell_and_are_bounded(monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 10)
    counts = np.random.default_rng(2).integers(0, 7, (6, 9))
    counts[3, 4], counts[5] = 75, 0
    layout = m.Blocks(counts)
    a, b = np.nonzero(counts)
    cell, block = layout.spread(a, b)
    assert set(cell) == set(range(len(a))) and block.max() < layout.count
    rows = np.zeros(layout.count)
    np.add.at(rows, block, (counts[a, b] / layout.wide[a, b])[cell])
    assert rows.max() <= 3 * m.BLOCK and rows.sum() == pytest.approx(counts.sum())
    # No block holds cells of two first centroids.
    assert all(len(set(a[cell[block == i]])) <= 1 for i in range(layout.count))
    blocks, bits = layout.routes(a[::3], b[::3])
    wants = np.unpackbits(bits, axis=1)
    met = {(int(i), int(j)) for line, i in enumerate(blocks) for j in np.flatnonzero(wants[line]) + layout.low[i]}
    cell, block = layout.spread(a[::3], b[::3])
    assert met == {(int(i), int(b[::3][c])) for c, i in zip(cell, block)}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(8, n // 60), 16))
    x = centres[rng.integers(len(centres), size=n)] + 0.15 * rng.normal(size=(n, 16))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_recall_and_candidates_of_clustered_vectors(spark, monkeypatch):
    shares = {}
    real = m.measured_coverage
    for n in (3000, 12000):
        monkeypatch.setattr(m, "measured_coverage", lambda *args: shares.setdefault(n, real(*args)))
        x = clustered(n, 7)
        got = search(spark, [(i, v.tolist()) for i, v in enumerate(x)])
        hit = 0
        for q in got:
            score = x @ x[q]
            score[q] = -np.inf
            hit += len(set(np.argsort(-score)[:20]) & {i for i, _ in got[q]})
        assert len(got) == n // 20 and hit >= 0.9 * 20 * len(got)
    # Candidates grow slower than the table.
    assert shares[12000] < 0.7 * shares[3000] < 0.35
