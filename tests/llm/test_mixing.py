import re
from collections import Counter

import pytest

from emberlog.llm import mixing as m
from emberlog.llm.common import table
from tests.llm.conftest import documents
from tests.oracle import TESTDATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(sizes):
    """Targets by raising the level step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * rest / open_weight >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * rest / open_weight for s in order}
        full |= over


def check(rows, got):
    sizes, taken = Counter(), Counter()
    source = {}
    for i, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
        source[i] = s
    want = water_filled(sizes)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in want:
        # A block at most is rounded off, and the last block of a shard may be short in each copy.
        assert abs(taken[s] - want[s]) <= 4 * m.BLOCK_TOKENS


def test_small_and_capped_sources(spark):
    rows = [(i, "w " * (i % 50), "en", "big") for i in range(300)] + [(400 + i, "w x", "en", "tiny") for i in range(4)] + [
        (500, None, None, None), (501, "a b c", None, None), (502, "", "en", "none")]
    check(rows, m.mix(documents(spark, rows)).collect())


def test_odd_rows(spark, odd_rows):
    rows = [(100 + k, *r[1:]) for k, r in enumerate(odd_rows)]
    check(rows, m.mix(documents(spark, rows)).collect())
    assert m.mix(documents(spark, odd_rows)).count() == len(odd_rows)


def test_many_shards_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_TOKENS", 1000)
    rows = [(i, "w " * (i * 7 % 400), "en", f"s{i * i % 5}") for i in range(200)]
    first = sorted(m.mix(documents(spark, rows)).collect())
    assert first == sorted(m.mix(documents(spark, rows[::-1])).collect())
    sizes, taken = Counter(), Counter()
    for r in first:
        taken[r.doc_id * r.doc_id % 5] += r.taken
        sizes[r.doc_id * r.doc_id % 5] = r.target
    assert all(abs(taken[s] - sizes[s]) < 0.05 * sizes[s] for s in sizes)


def test_highest_quotients(spark):
    claims = {"a": 530.0, "b": 240.0, "c": 150.0, "d": 80.0, "e": 0.0}
    for seats in (1, 7, 23, 400):
        won = Counter(s for _, s in sorted(((-claims[s] / (2 * k + 1), s) for s in claims if claims[s] for k in range(seats)))[:seats])
        df = spark.createDataFrame([(s, c, 10_000, seats) for s, c in claims.items()], "s string, c double, top long, seats long")
        got = m.apportion(df, m.F.col("seats"), "c", "top", [], [m.F.col("s")]).collect()
        assert {r.s: r._quota for r in got} == {s: won[s] for s in claims}


def test_empty_table(spark):
    got = m.mix(documents(spark, []))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert got.count() == 0


def test_sources_of_the_tables(spark):
    sf = f"{TESTDATA}/sf0.01"
    source = {r.doc_id: r.source for r in table(spark, sf, "documents").select("doc_id", "source").collect()}
    taken, target = Counter(), {}
    for r in m.mix(table(spark, sf, "documents")).collect():
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) < 0.01 * target[s] for s in target)
