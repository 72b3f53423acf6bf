import hashlib

from emberlog.llm import exact_dedup as m
from tests.llm.conftest import documents


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    return groups


def check(spark, rows, **settings):
    got = m.exact_dedup(documents(spark, rows), **settings).collect()
    groups = brute(rows)
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_odd_rows(spark, odd_rows):
    check(spark, odd_rows)


def test_many_levels_and_shared_blocks(spark):
    # Texts that share blocks, differ in one byte, or are prefixes of each other.
    base = "abcdefgh" * 40
    rows = [(i, base[:8 * (i % 12)], None, None) for i in range(60)]
    rows += [(100 + i, base[:i] + "X" + base[i + 1:], None, None) for i in range(0, 90, 7)]
    rows += [(300 + i, base[i % 3:], None, None) for i in range(9)]
    check(spark, rows, block_bytes=8)


def test_hot_groups_are_salted(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT_ROWS", 5)
    monkeypatch.setattr(m, "SALTS", 4)
    check(spark, [(i, "same text over two blocks" if i % 2 else f"other {i // 8}", None, None) for i in range(80)], block_bytes=16)


def test_empty_table(spark):
    got = m.exact_dedup(documents(spark, []))
    assert got.count() == 0
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
