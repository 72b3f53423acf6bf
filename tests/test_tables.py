import random
from datetime import timedelta

import pytest
from emberlog.plans.query import LogQuery
from emberlog.sources.samples import read_samples, series
from emberlog.sources.tables import LogTables, object_manifest
from emberlog.operators.counters import storage_by_tier
from tests.helpers import NOW, batch, plain, plan

HOUR = timedelta(hours=1)


@pytest.fixture
def tables(spark, tmp_path):
    return LogTables(spark, str(tmp_path / "tables"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_empty_tables(tables):
    assert tables.hot().count() == tables.cold().count() == tables.manifest().count() == 0
    assert tables.compact(NOW) is None
    assert tables.search(LogQuery(), NOW).count() == 0


def test_replaying_a_batch_replaces_it(spark, tables):
    rows = plain(spark, batch(10, "api", NOW))
    tables.append(rows, 0)
    tables.append(rows, 0)
    assert tables.hot().count() == 10
    tables.append(rows, 1)
    assert tables.hot().count() == 20


def test_compaction_moves_aged_rows_once(spark, tables):
    tables.append(plain(spark, batch(5, "old", NOW - 7 * HOUR) + batch(3, "new", NOW)), 0)
    row = tables.compact(NOW)
    assert row["rows"] == 5 and row["upto_batch"] == 0
    assert ids(tables.hot()) == ids(plain(spark, batch(3, "new", NOW)))
    assert tables.cold().count() == 5
    assert tables.compact(NOW) is None
    assert tables.manifest().count() == 1
    # A replay of a compacted batch stays invisible.
    tables.append(plain(spark, batch(5, "old", NOW - 7 * HOUR) + batch(3, "new", NOW)), 0)
    assert tables.hot().count() == 3 and tables.cold().count() == 5


def test_a_failed_compaction_loses_nothing(spark, tables):
    tables.append(plain(spark, batch(5, "old", NOW - 7 * HOUR)), 0)
    publish = tables.folder.publish
    tables.folder.publish = lambda *_: False
    with pytest.raises(RuntimeError):
        tables.compact(NOW)
    assert tables.hot().count() == 5 and tables.cold().count() == 0
    tables.folder.publish = publish
    assert tables.compact(NOW)["rows"] == 5
    assert tables.hot().count() == 0 and tables.cold().count() == 5


def test_an_unfinished_batch_is_not_compacted(spark, tables, tmp_path):
    tables.append(plain(spark, batch(5, "old", NOW - 7 * HOUR)), 0)
    tables.append(plain(spark, batch(5, "late", NOW - 8 * HOUR)), 1)
    next((tmp_path / "tables" / "hot" / "commits").glob("0-1-*.json")).unlink()
    assert tables.compact(NOW)["rows"] == 5
    # Without its commit the second batch is not there.
    assert ids(tables.hot()) == []


def test_every_row_is_visible_exactly_once(spark, tables):
    """Random late rows and compactions in between: hot and cold together are what was appended."""
    rng = random.Random(11)
    written = []
    for n in range(6):
        at = NOW + n * HOUR
        rows = [r for i in range(4) for r in batch(3, f"b{n}-{i}", at - rng.choice([0, 1, 5, 7, 30]) * HOUR)]
        written += [r[0] for r in rows]
        tables.append(plain(spark, rows), n, run=n // 3)
        if n % 2:
            tables.compact(at)
        assert sorted(ids(tables.hot()) + ids(tables.cold())) == sorted(written)


def test_hot_prunes_moved_batches(spark, tables):
    tables.append(plain(spark, batch(2, "a", NOW - 7 * HOUR)), 0)
    tables.compact(NOW)
    tables.append(plain(spark, batch(2, "b", NOW)), 1)
    assert "PushedFilters: [Not(And(EqualTo(run,0)" in plan(tables.hot()) or "EqualTo(run,0)" in plan(tables.hot())
    assert ids(tables.hot()) == ["b-0", "b-1"]
    tables.append(plain(spark, batch(2, "c", NOW - 7 * HOUR) + batch(1, "young", NOW - HOUR)), 2)
    tables.compact(NOW)
    text = plan(tables.hot())
    assert text.count("Scan parquet") == 2 and "GreaterThanOrEqual(timestamp" in text
    assert ids(tables.hot()) == ["b-0", "b-1", "young-0"]


def test_cutoffs_do_not_go_back(spark, tables):
    tables.append(plain(spark, batch(2, "a", NOW - 7 * HOUR)), 0)
    tables.compact(NOW)
    tables.append(plain(spark, batch(2, "b", NOW - 7 * HOUR)), 1)
    tables.compact(NOW - 10 * HOUR)
    assert sorted(ids(tables.hot()) + ids(tables.cold())) == ["a-0", "a-1", "b-0", "b-1"]


def test_search_over_both_tiers(spark, tables):
    tables.append(plain(spark, batch(4, "old", NOW - 30 * HOUR) + batch(4, "new", NOW - HOUR)), 0)
    tables.compact(NOW)
    tables.append(plain(spark, batch(2, "late", NOW - 30 * HOUR)), 1)
    query = LogQuery(start=NOW - 48 * HOUR, end=NOW, limit=100)
    found = tables.search(query, NOW).collect()
    assert [r.id for r in found] == ["new-3", "new-2", "new-1", "new-0", "late-1", "late-0", "old-0", "old-1", "old-2", "old-3"]
    assert [r.tier for r in found] == ["hot"] * 6 + ["cold"] * 4
    assert tables.search(LogQuery(start=NOW - 2 * HOUR, end=NOW), NOW).count() == 4


def test_cold_range_spans_months(spark, tables):
    """Rows of later months in the range are found, whatever chunk they were archived in."""
    rows = batch(2, "jan", NOW.replace(month=1, day=31)) + batch(2, "feb", NOW.replace(month=2, day=1))
    tables.append(plain(spark, rows), 0)
    tables.compact(NOW)
    query = LogQuery(start=NOW.replace(month=1, day=30), end=NOW.replace(month=2, day=2))
    assert tables.search(query, NOW).count() == 4


def test_cold_prunes_dates_and_compactions(spark, tables):
    tables.append(plain(spark, batch(5, "a", NOW - 240 * HOUR) + batch(5, "b", NOW - 200 * HOUR)), 0)
    tables.compact(NOW)
    tables.append(plain(spark, batch(5, "c", NOW - 48 * HOUR)), 1)
    tables.compact(NOW)
    query = LogQuery(start=NOW - 210 * HOUR, end=NOW - 190 * HOUR, source="b")
    cold = tables.cold(query.start, query.end)
    assert len({r[0] for r in cold.select("compaction").distinct().collect()}) == 1
    text = plan(query.match(cold))
    assert "PartitionFilters: [isnotnull(dt" in text and "EqualTo(source,b)" in text
    assert query.match(cold).count() == 5


def test_many_rows_with_one_timestamp_spread_over_files(spark, tables):
    rows = [(f"r{i}", NOW - 7 * HOUR, "s", "INFO", "m", None, None, None) for i in range(4000)]
    tables.append(plain(spark, rows).repartition(4), 0)
    tables.compact(NOW, files=4)
    counts = [r.entry_count for r in object_manifest(tables.cold()).collect()]
    assert len(counts) == 4 and sum(counts) == 4000


def test_object_manifest_and_storage(spark, tables):
    tables.append(plain(spark, batch(25, "a", NOW - 7 * HOUR)), 0)
    tables.compact(NOW, files=1, rows_per_file=10)
    rows = object_manifest(tables.cold()).orderBy("start_time", "entry_count").collect()
    assert sorted(r.entry_count for r in rows) == [5, 10, 10]
    assert {r.start_time for r in rows} == {"2024-03-10T05:00:00Z"}
    usage = storage_by_tier(spark, tables.folder.child("cold"), "cold").first()
    assert usage.objects == 3 and usage.bytes > 0
    assert "content" not in plan(storage_by_tier(spark, tables.folder.child("cold"), "cold"))


def test_eviction_and_clean_up(spark, tables):
    tables.append(plain(spark, batch(5, "a", NOW - 7 * HOUR)), 0)
    tables.append(plain(spark, batch(5, "b", NOW - 30 * HOUR) + batch(1, "b2", NOW)), 1)
    # The old rows of the second batch go, its young row and the first batch stay.
    assert tables.evict(NOW) == 5
    assert ids(tables.hot()) == [*[f"a-{i}" for i in range(5)], "b2-0"]
    assert tables.evict(NOW) == 0
    tables.append(plain(spark, batch(2, "c", NOW - 7 * HOUR)), 2)
    assert tables.compact(NOW)["upto_batch"] == 2
    before = ids(tables.stored())
    counts = sorted(tuple(r) for r in tables.batches().select("batch_id", "accepted").collect())
    assert tables.clean() == 3 and tables.clean() == 0
    assert tables.folder.glob("hot/new/*.parquet") == [] and len(tables.folder.glob("manifest/*.json")) == 1
    assert ids(tables.stored()) == before
    assert sorted(tuple(r) for r in tables.batches().select("batch_id", "accepted").collect()) == counts == [(0, 5), (1, 6), (2, 2)]
    assert tables.committed_batch() == (0, 2)
    # A replay of a cleaned batch does not bring it back.
    tables.append(plain(spark, batch(2, "c", NOW - 7 * HOUR)), 2)
    assert ids(tables.stored()) == before


def test_an_eviction_after_a_compaction_keeps_rows_within_retention(spark, tables):
    tables.append(plain(spark, batch(2, "a", NOW - 7 * HOUR) + batch(1, "young", NOW)), 0)
    tables.compact(NOW)
    tables.append(plain(spark, batch(3, "late", NOW - 10 * HOUR) + batch(4, "past", NOW - 30 * HOUR) + batch(1, "new", NOW)), 1)
    assert tables.evict(NOW) == 4
    assert ids(tables.stored()) == ["a-0", "a-1", "late-0", "late-1", "late-2", "new-0", "young-0"]
    assert ids(tables.hot()) == ["new-0", "young-0"]
    assert tables.search(LogQuery(start=NOW - 11 * HOUR, end=NOW - 9 * HOUR), NOW).count() == 3
    assert sorted(r.rows for r in tables.manifest().collect()) == [2, 3]
    assert tables.evict(NOW) == 0


def test_a_search_during_a_compaction_finds_all_rows(spark, tables):
    tables.append(plain(spark, batch(5, "old", NOW - 7 * HOUR) + batch(2, "new", NOW)), 0)
    cold = tables.cold

    def cold_then_compact(*args):
        found = cold(*args)
        tables.compact(NOW)
        return found

    tables.cold = cold_then_compact
    found = tables.search(LogQuery(start=NOW - 10 * HOUR, end=NOW + HOUR, limit=100), NOW)
    assert len(tables.folder.glob("manifest/*.json")) == 1
    assert ids(found) == ids(plain(spark, batch(5, "old", NOW) + batch(2, "new", NOW)))


def test_interleaved_runs_and_rows_without_a_time_lose_nothing(spark, tables):
    nameless = [("none", None, "s", "INFO", "m", None, None, None)]
    tables.append(plain(spark, batch(3, "r1", NOW - 7 * HOUR) + nameless), 4, run=1)
    tables.compact(NOW)
    tables.append(plain(spark, batch(4, "r0", NOW - 8 * HOUR)), 0, run=0)
    tables.append(plain(spark, batch(2, "gap", NOW - 8 * HOUR)), 2, run=1)
    everything = sorted(ids(plain(spark, batch(3, "r1", NOW) + batch(4, "r0", NOW) + batch(2, "gap", NOW))) + ["none"])
    assert ids(tables.stored()) == everything
    tables.compact(NOW)
    tables.clean()
    assert ids(tables.stored()) == everything
    assert "none" in ids(tables.hot()) and tables.cold().count() == 9


def test_compaction_merges_small_files(spark, tables, monkeypatch):
    monkeypatch.setattr("emberlog.sources.tables.MERGE_BATCHES", 5)
    for n in range(5):
        tables.append(plain(spark, batch(2, f"b{n}", NOW)), n)
    assert tables.compact(NOW) is None
    assert tables.clean() == 5
    assert tables.hot().count() == 10 and len(tables.folder.glob("hot/segments/*")) == 1


def test_thousands_of_batches_are_listed_at_once(spark, tables, tmp_path):
    import shutil
    import time

    tables.append(plain(spark, batch(1, "a", NOW)).coalesce(1), 0)
    new = tmp_path / "tables" / "hot" / "new"
    only = next(new.glob("*.parquet"))
    commits = tmp_path / "tables" / "hot" / "commits"
    commit = next(commits.glob("0-0-*.json"))
    for n in range(1, 3000):
        shutil.copyfile(only, new / f"0-{n}-x-0.parquet")
        shutil.copyfile(commit, commits / f"0-{n}-x.json")
    started = time.perf_counter()
    rows = tables.hot()
    assert time.perf_counter() - started < 3
    assert tables.committed_batch() == (0, 2999)
    assert rows.count() == 3000


def test_metric_samples(spark, tmp_path):
    path = str(tmp_path / "samples")
    rows = [(NOW, "lag", {"group": "g"}, None, 5.0), (NOW + HOUR, "lag", None, None, 6.0), (NOW, "other", None, 0.1, 1.0)]
    spark.createDataFrame(rows, "ts timestamp, name string, labels map<string,string>, le double, value double").write.parquet(path)
    found = series(read_samples(spark, path), "lag", ("group",), end=NOW + HOUR).orderBy("ts").collect()
    assert [(r.group, r.value) for r in found] == [("g", 5.0), ("", 6.0)]


def test_merged_cold_directories_stay_logarithmic(spark, tables):
    wanted, rng = [], random.Random(4)
    for k in range(12):
        rows = batch(rng.randint(1, 3), f"s{k}", NOW - (30 - k) * HOUR)
        tables.append(plain(spark, rows), k)
        tables.compact(NOW - 20 * HOUR + timedelta(days=1))
        tables.merge_cold(fanout=3)
        wanted += [r[0] for r in rows]
        sizes = [c["rows"] for c in tables.snapshot().cold]
        for level in range(4):
            assert sum(3 ** level <= n < 3 ** (level + 1) for n in sizes) < 3
    assert ids(tables.cold()) == sorted(wanted) and sum(sizes) == len(wanted)
    # The index and the bounds are those of the merged rows; a range and a value still prune.
    request = LogQuery(start=NOW - 40 * HOUR, end=NOW, source="s5")
    assert ids(tables.search(request, NOW)) == sorted(i for i in wanted if i.startswith("s5-"))
    before = ids(tables.stored())
    tables.clean()
    assert ids(tables.stored()) == before and len(tables.folder.glob("cold/compaction=*")) == len(sizes)
    assert tables.merge_cold(fanout=3) == 0
    with pytest.raises(ValueError):
        tables.merge_cold(fanout=1)


def test_merge_that_loses_the_race_changes_nothing(spark, tables):
    for k in range(2):
        tables.append(plain(spark, batch(3, f"s{k}", NOW - 10 * HOUR)), k)
        tables.compact(NOW)
    before, publish = tables.snapshot(), tables.folder.publish
    tables.folder.publish = lambda *_: False
    with pytest.raises(RuntimeError):
        tables.merge_cold(fanout=2)
    tables.folder.publish = publish
    assert tables.snapshot() == before and len(tables.folder.glob("cold/compaction=*")) == 2
    assert tables.cold().count() == 6
