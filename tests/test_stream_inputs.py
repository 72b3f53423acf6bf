"""Folders that streams read: many files per batch, batches of bounded size, samples in chunks."""

import json
from contextlib import contextmanager
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

import __spark_entry__ as entry
from emberlog.sources.files import Folder
from emberlog.streaming.ordered import CHUNK, NO_SEQ, in_order, pack_samples, unpack_samples
from emberlog.workload import streams
from emberlog.workload.streams import FILES, _appended, _cuts, _Parts, _weekly, _weekly_together
from tests.helpers import NOW
from tests.oracle import compare, connect


def batches(spark, path, files, schema, tmp_path):
    """The rows of each batch of a stream that takes so many files at once."""
    seen = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    (stream.writeStream.foreachBatch(lambda rows, _: seen.append(rows.collect())).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    return seen


@pytest.mark.parametrize("empty", [None, 2])
def test_a_part_is_many_files_and_one_batch(spark, tmp_path, empty):
    rows = spark.range(1200).filter(F.col("id") % FILES != F.lit(-1 if empty is None else empty))
    path = str(tmp_path / "in")
    parts = _Parts(rows, F.col("id") % FILES, path, file_rows=60)
    assert parts.files == 5
    # As in the ingest: the last parts come when the first ones have been written.
    parts.write(range(2))
    parts.write(range(2, FILES))
    found = batches(spark, path, parts.files, rows.schema, tmp_path)
    expected = [[] if i == empty else list(range(i, 1200, FILES)) for i in range(FILES)]
    assert [sorted(r.id for r in b) for b in found] == expected


def test_weeks_with_many_rows_are_cut(spark, tmp_path):
    rows = spark.createDataFrame([(i, NOW + i * timedelta(minutes=10) if i else None) for i in range(3000)], "n long, ts timestamp")
    path = str(tmp_path / "in")
    files = _weekly(rows, "ts", path, slice_rows=400, file_rows=100)
    found = batches(spark, path, files, rows.schema, tmp_path)
    # Three weeks; the row without a time comes first, and the last batch is the row that ends the stream.
    assert files > 1 and len(found) > 7 and max(map(len, found)) <= 400
    numbers = [sorted(r.n for r in b) for b in found]
    assert sum(numbers[:-1], []) == list(range(3000)) and numbers[-1] == [2999]


def test_ready_samples_come_in_chunks(spark, tmp_path):
    """A series of many samples, out of order and with a tie at the end of a chunk, is handed over in order and never whole."""
    n, path, out = 2 * CHUNK + 500, str(tmp_path / "in"), str(tmp_path / "out")
    at = F.when(F.col("id") == CHUNK, CHUNK - 1).otherwise(F.col("id"))
    rows = spark.range(n).select(F.lit("a").alias("k"), (F.lit(NOW) + F.make_dt_interval(secs=at)).alias("ts"), F.col("id").alias("seq"), F.lit(1.0).alias("value"))
    end = rows.limit(1).withColumn("ts", F.col("ts") + F.expr("interval 9 days"))
    rows.orderBy(F.hash("seq")).coalesce(1).write.parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)

    def count(held, ready, now):
        last, total = held or (-1, 0)
        assert [s[1] for s in ready] == sorted(s[1] for s in ready)
        ordered = not ready or ready[0][1] > last
        total += len(ready)
        return (ready[-1][1] if ready else last, total), [(len(ready), total, ordered)] if ready else [], None

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    judged = in_order(stream, ["k"], "ts", "seq", "value", "1 minute", count, "last long, total long", "n long, total long, ordered boolean")
    (judged.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    found = [tuple(r) for r in spark.read.schema("k string, n long, total long, ordered boolean").parquet(out).orderBy("total").collect()]
    # The samples of the last minute wait for the row that ends the stream.
    assert found[:4] == [("a", CHUNK, CHUNK, True), ("a", CHUNK, 2 * CHUNK, True), ("a", 440, n - 60, True), ("a", 60, n, True)]


@contextmanager
def progress(spark):
    """What the streams that run meanwhile tell about their batches."""
    seen = []

    class Listener(StreamingQueryListener):
        def onQueryProgress(self, event):
            seen.append(json.loads(event.progress.json))

        def onQueryStarted(self, event):
            pass

        onQueryIdle = onQueryTerminated = onQueryStarted

    listener = Listener()
    spark.streams.addListener(listener)
    try:
        yield seen
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)


def matches_sql(spark, name, folder):
    return compare(entry.queries()[name](spark, folder), connect(folder), entry.oracle_sql()[name])


def test_hours_are_cut_by_rows_and_weeks():
    assert _cuts({}, 10) == {None: 0}
    assert _cuts({None: 3}, 10) == {None: 0}
    # The first day begins at hour 0; hour 3 has too many rows alone, and hour 168 begins a week.
    assert _cuts({1: 4, 2: 6, 3: 25, 4: 1, 167: 9, 168: 1, 169: 1}, 10) == {None: 0, 1: 0, 2: 0, 3: 1, 4: 2, 167: 2, 168: 3, 169: 3}
    assert _cuts({None: 8, 5: 3}, 10) == {None: 0, 5: 1}


@pytest.mark.parametrize("times", [True, False])
def test_tables_are_cut_at_the_same_moments(spark, tmp_path, monkeypatch, times):
    if not times:
        monkeypatch.setattr(Folder, "keeps_times", lambda self: False)
    at = F.lit(NOW) + F.make_dt_interval(hours=F.col("n"))
    # Five rows an hour beside one, which pauses for a day.
    many = spark.range(1000).select(F.floor(F.col("id") / 5).alias("n")).withColumn("ts", at)
    few = spark.range(200).select(F.col("id").alias("n")).filter("n NOT BETWEEN 40 AND 63").withColumn("ts", at)
    paths = [str(tmp_path / name) for name in ("many", "few")]
    files = _weekly_together([(many, "ts", paths[0]), (few, "ts", paths[1])], slice_rows=100, file_rows=40)
    assert files == [3, 1] if times else files[0] > files[1]
    left, right = (batches(spark, path, n, many.schema, tmp_path / f"cp{i}") for i, (path, n) in enumerate(zip(paths, files)))
    assert len(left) == len(right) > 10
    spans = [(min(r.n for r in b), max(r.n for r in b)) for b in left[:-1]]
    assert sorted(r.n for b in left[:-1] for r in b) == sorted([*range(200)] * 5) and max(map(len, left)) <= 100
    for (first, last), b in zip(spans, right):
        assert sorted(r.n for r in b) == [n for n in range(first, last + 1) if not 40 <= n <= 63]
    # Both end with a row far in the future.
    assert [[r.n for r in b[-1]] for b in (left, right)] == [[199], [199]]


def test_rows_without_time_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, None)], "n long, ts timestamp")
    for name, table, expected in (("nulls", rows, [1, 2]), ("none", rows.limit(0), [])):
        path = str(tmp_path / name)
        assert _weekly(table, "ts", path) == 1
        found = batches(spark, path, 1, rows.schema, tmp_path / f"{name}-cp")
        assert sorted(r.n for r in found[0]) == expected


def test_the_delivery_check_holds_a_slice_of_both_streams(spark, tmp_path, monkeypatch):
    """Four items an order, in batches of 600 rows: orders do not run ahead of the items."""
    monkeypatch.setattr(streams, "JOIN_ROWS", 600, raising=False)
    spark.range(2000).selectExpr("id AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    items = spark.range(8000).selectExpr("id div 4 AS l_orderkey").filter("l_orderkey % 50 <> 0")
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    with progress(spark) as seen:
        found = entry.queries()["stream_delivery_lost"](spark, str(tmp_path)).collect()
    assert sorted(int(r.id) for r in found) == list(range(0, 2000, 50))
    assert max(p["numInputRows"] for p in seen) <= 600
    # A batch and what its predecessor leaves for the time bound.
    assert max(o["numRowsTotal"] for p in seen for o in p["stateOperators"]) <= 1200


@pytest.mark.parametrize("name", ["stream_counter_rate", "stream_alert_hold_for"])
def test_samples_in_order_come_in_bounded_batches(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(streams, "ORDER_ROWS", 500, raising=False)
    ts = F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)) + F.make_dt_interval(mins=F.col("id") * 7)
    rows = spark.range(3000).select(
        F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") * 31 % 90).alias("user_id"),
        F.element_at(F.array(F.lit("click"), F.lit("view")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"),
        (F.pmod(F.xxhash64("id"), F.lit(9000)) / 100).alias("value"), F.lit("{}").alias("props"))
    # One file, which both engines read.
    rows.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    with progress(spark) as seen:
        assert matches_sql(spark, name, str(tmp_path)) is None
    assert len(seen) > 6 and max(p["numInputRows"] for p in seen) <= 500


def test_waiting_samples_are_packed():
    columns = [np.arange(1000) * 7, np.where(np.arange(1000) % 3, np.arange(1000), NO_SEQ), np.where(np.arange(1000) % 5, 0.1, np.nan)]
    data = pack_samples(columns)
    assert len(data) == 24 * 1000
    for column, found in zip(columns, unpack_samples(data)):
        np.testing.assert_array_equal(column, found)
    assert [len(c) for c in unpack_samples(b"")] == [0, 0, 0]


def test_the_state_goes_to_python_once_per_series(spark, tmp_path):
    """Spark repeats a series' state with each Arrow batch of its rows; the settings hold for the stream only."""
    before = {name: spark.conf.get(name) for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions")}
    path = str(tmp_path / "in")
    spark.range(25_000).select(F.lit("a").alias("k"), "id").coalesce(1).write.parquet(path)

    def count(key, frames, state):
        yield pd.DataFrame([(key[0], sum(1 for _ in frames))], columns=["k", "n"])

    stream = spark.readStream.schema("k string, id long").parquet(path)
    counted = stream.groupBy("k").applyInPandasWithState(count, "k string, n long", "n long", "append", "NoTimeout")
    assert [r.n for r in _appended(spark, counted, "k string, n long").collect()] == [1]
    assert {name: spark.conf.get(name) for name in before} == before
