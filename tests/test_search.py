from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.retention import drain, evict, lateness, split_by_age
from emberlog.plans.query import LogQuery
from emberlog.plans.search import envelope, search, summarize, with_position
from tests.helpers import NOW, batch, logs, plan

MINUTE = timedelta(minutes=1)
HOUR = timedelta(hours=1)
AROUND = {"start": NOW - MINUTE, "end": NOW + MINUTE}


def run(spark, hot, query, as_of=NOW, cold=None):
    cold = hot.limit(0) if cold is None else cold
    return search(hot, cold, query, as_of).collect()


def test_store_and_query(spark):
    assert len(run(spark, logs(spark, batch(100, "api", NOW)), LogQuery(source="api", **AROUND))) == 100


def test_source_and_text_filter(spark):
    rows = logs(spark, batch(50, "api", NOW), batch(50, "worker", NOW))
    assert len(run(spark, rows, LogQuery(source="worker", **AROUND))) == 50
    assert len(run(spark, rows, LogQuery(text="message 7 from api", **AROUND))) == 1


def test_time_window(spark):
    rows = logs(spark, batch(10, "api", NOW - 2 * HOUR), batch(10, "api", NOW))
    assert len(run(spark, rows, LogQuery(**AROUND))) == 10


def test_drain(spark):
    rows = logs(spark, batch(30, "api", NOW - 2 * HOUR), batch(20, "api", NOW))
    drained, kept = split_by_age(rows, NOW - HOUR)
    assert (drained.count(), kept.count()) == (30, 20)
    assert len(run(spark, kept, LogQuery(source="api", **AROUND))) == 20


def test_limit(spark):
    assert len(run(spark, logs(spark, batch(500, "api", NOW)), LogQuery(limit=25, **AROUND))) == 25


def test_limit_takes_first_arrivals_and_shows_newest_first(spark):
    found = run(spark, logs(spark, batch(10, "api", NOW)), LogQuery(limit=3, **AROUND))
    assert [r.id for r in found] == ["api-2", "api-1", "api-0"]
    newest = run(spark, logs(spark, batch(10, "api", NOW)), LogQuery(limit=3, order="newest", **AROUND))
    assert [r.id for r in newest] == ["api-9", "api-8", "api-7"]


def test_limit_zero_returns_a_thousand_per_tier(spark):
    hot = logs(spark, batch(1200, "api", NOW))
    cold = logs(spark, batch(1200, "api", NOW - 10 * HOUR))
    found = run(spark, hot, LogQuery(start=NOW - 24 * HOUR, end=NOW + MINUTE), cold=cold)
    assert len(found) == 2000
    assert {r.tier for r in found} == {"hot", "cold"}


def test_negative_limit_is_rejected():
    with pytest.raises(ValueError):
        LogQuery(limit=-1)
    with pytest.raises(ValueError):
        LogQuery(order="oldest")


def test_merged_order_is_hot_descending_then_cold_ascending(spark):
    hot = logs(spark, batch(3, "h", NOW))
    cold = logs(spark, batch(3, "c", NOW - 10 * HOUR))
    query = LogQuery(start=NOW - 24 * HOUR, end=NOW + MINUTE, limit=5)
    found = with_position(search(hot, cold, query, NOW)).orderBy("position").collect()
    assert [r.id for r in found] == ["h-2", "h-1", "h-0", "c-0", "c-1"]


def test_routing():
    cutoff = NOW - 6 * HOUR
    def tier(start, end):
        return LogQuery(start=start, end=end).route(NOW).tier
    assert tier(cutoff, NOW) == "hot"
    assert tier(cutoff - MINUTE, cutoff) == "cold"
    assert tier(cutoff - MINUTE, cutoff + MINUTE) == "tiered"
    # Neither tier: an empty range after the cutoff is called hot.
    assert tier(cutoff, cutoff) == "hot"


def test_default_range():
    filled = LogQuery().with_defaults(NOW)
    assert (filled.start, filled.end) == (NOW - HOUR, NOW)
    only_end = LogQuery(end=NOW - 2 * HOUR).with_defaults(NOW)
    assert only_end.start > only_end.end


def test_from_request():
    assert LogQuery.from_request({"source": "api", "limit": 100}) == LogQuery(source="api", limit=100)
    full = LogQuery.from_request({
        "start_time": "2024-03-10T12:00:00Z", "end_time": "0001-01-01T00:00:00Z", "level": "ERROR", "query": "x",
        "labels": {"a": "b"}})
    assert (full.start, full.end, full.level, full.text, full.labels) == (NOW, None, "ERROR", "x", {"a": "b"})


def test_only_an_old_end_finds_nothing(spark):
    rows = logs(spark, batch(10, "api", NOW - 3 * HOUR))
    assert run(spark, rows, LogQuery(end=NOW - 2 * HOUR)) == []


def test_range_is_inclusive(spark):
    rows = logs(spark, batch(3, "api", NOW))
    ms = timedelta(milliseconds=1)
    assert len(run(spark, rows, LogQuery(start=NOW, end=NOW + 2 * ms))) == 3
    assert len(run(spark, rows, LogQuery(start=NOW + ms, end=NOW + ms))) == 1


def test_cold_is_clipped_at_the_cutoff_but_hot_is_not(spark):
    at = NOW - 5 * HOUR
    both = logs(spark, batch(1, "x", at), batch(1, "y", NOW - 7 * HOUR))
    found = run(spark, both, LogQuery(start=NOW - 8 * HOUR, end=NOW, limit=10), cold=both)
    assert sorted((r.id, r.tier) for r in found) == [("x-0", "hot"), ("y-0", "cold"), ("y-0", "hot")]


def test_aged_rows_still_hot_are_found(spark):
    hot = logs(spark, batch(5, "api", NOW - 7 * HOUR))
    query = LogQuery(start=NOW - 8 * HOUR, end=NOW - 6 * HOUR - MINUTE)
    assert len(run(spark, hot, query)) == 5
    assert query.route(NOW).tier == "cold"
    assert search(hot, hot.limit(0), query, NOW, uncompacted=False).count() == 0


def test_level_is_a_plain_string(spark):
    rows = logs(spark, batch(2, "a", NOW, level="ERROR"), batch(3, "a", NOW, level="error"), batch(1, "a", NOW, level="X"))
    assert len(run(spark, rows, LogQuery(level="error", **AROUND))) == 3
    assert len(run(spark, rows, LogQuery(level="X", **AROUND))) == 1


def test_text_has_no_wildcards(spark):
    rows = logs(spark, batch(5, "50%_off", NOW), batch(5, "50 x off", NOW))
    assert len(run(spark, rows, LogQuery(text="50%_off", **AROUND))) == 5


def test_labels(spark):
    rows = logs(spark, batch(2, "a", NOW, labels={"env": "prod", "zone": "1"}), batch(3, "b", NOW, labels={"env": "dev"}),
                batch(4, "c", NOW))
    def count(labels):
        return len(run(spark, rows, LogQuery(labels=labels, **AROUND)))
    assert count({"env": "prod"}) == 2
    assert count({"env": "prod", "zone": "2"}) == 0
    assert count({"zone": ""}) == 7
    assert count({"zone": "", "env": "dev"}) == 3


def test_summary_and_envelope(spark):
    hot, cold = logs(spark, batch(30, "api", NOW, labels={"a": "1"})), logs(spark, batch(0, "api", NOW))
    cold = hot.limit(0)
    query = LogQuery(limit=10, **AROUND)
    row = summarize(hot, cold, query, NOW).first()
    assert (row.total_count, row.matched_count, row.tier) == (10, 30, "hot")
    found = envelope(hot, cold, query, NOW).first()
    assert found.total_count == 10 and found.entries[0].id == "api-9" and found.entries[0].labels == {"a": "1"}
    nothing = envelope(hot, cold, LogQuery(source="none", **AROUND), NOW).first()
    assert nothing.entries == [] and nothing.total_count == 0


def test_evict_and_lateness(spark):
    rows = logs(spark, batch(2, "old", NOW - 25 * HOUR), batch(3, "mid", NOW - 7 * HOUR), batch(4, "new", NOW))
    kept, evicted = evict(rows, NOW)
    assert (kept.count(), evicted.count()) == (7, 2)
    cold, hot = drain(rows, NOW)
    assert (cold.count(), hot.count()) == (5, 4)
    classes = lateness(rows, NOW).groupBy("lateness").count().collect()
    assert {r["lateness"]: r["count"] for r in classes} == {"expired": 2, "late": 3, "on_time": 4}


def test_predicates_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = logs(spark, batch(10, "api", NOW)).withColumn("dt", F.to_date("timestamp"))
    rows.write.partitionBy("dt").parquet(path)
    stored = spark.read.parquet(path)
    text = plan(LogQuery(source="api", level="INFO", **AROUND).match(stored).select("id"))
    assert "PartitionFilters: [isnotnull(dt" in text
    assert "EqualTo(source,api)" in text and "GreaterThanOrEqual(timestamp" in text
    assert "message" not in text.split("ReadSchema")[1]


def test_search_plan(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs(spark, batch(10, "api", NOW)).write.parquet(path)
    stored = spark.read.parquet(path)
    tiered = search(stored, stored, LogQuery(start=NOW - 24 * HOUR, end=NOW, limit=5), NOW)
    text = plan(tiered)
    assert text.count("TakeOrderedAndProject") == 3
    assert "Python" not in text
    hot_only = plan(search(stored, stored, LogQuery(start=NOW - HOUR, end=NOW, limit=5), NOW))
    assert hot_only.count("Scan parquet") == 1
