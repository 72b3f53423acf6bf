"""The record log: offsets, bounded batches, restarts, appends that show whole or not at all."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.schema import RECORD_SCHEMA
from emberlog.session import shared_dir
from emberlog.sources.record_log import LogStreamReader, RecordLog, log_records

# Times far from any epoch come through.
T0_US = (datetime(1, 3, 10, tzinfo=timezone.utc) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def numbered(spark, low, high, hot=False):
    ids = spark.range(low, high, 1, 3)
    part = F.lit(0) if hot else F.col("id") % 3
    return ids.select(F.when(F.col("id") % 5 != 0, F.col("id").cast("string")).alias("key"), F.concat(F.lit("v"), F.col("id")).alias("value"),
                      part.cast("int").alias("partition"), F.timestamp_micros(F.lit(T0_US) + F.col("id") * 1_000_000).alias("timestamp"))


def run(spark, path, target, checkpoint, most=None):
    sizes = []

    def keep(rows, batch):
        rows.write.mode("append").parquet(target)
        sizes.append(rows.count())

    job = log_records(spark, path, most, checkpoint if most else None).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()
    try:
        job.processAllAvailable()
    finally:
        job.stop()
    return [n for n in sizes if n]


def test_stream_table_and_restart_agree(spark):
    path, target, checkpoint = (shared_dir(spark, p) for p in ("log", "target", "checkpoint"))
    log = RecordLog(spark, path)
    log.append(numbered(spark, 0, 100))
    first = run(spark, path, target, checkpoint, 30)
    log.append(numbered(spark, 100, 140, hot=True))
    second = run(spark, path, target, checkpoint, 30)
    # Bounded before and after the restart, nothing twice.
    assert first == [30, 30, 30, 10] and second == [30, 10]
    streamed = spark.read.schema(RECORD_SCHEMA).parquet(target)
    table = log.records()
    assert streamed.columns == table.columns and table.count() == 140
    assert streamed.exceptAll(table).count() == 0 and table.exceptAll(streamed).count() == 0
    for r in table.groupBy("partition").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("d"), F.max("offset").alias("last")).collect():
        assert r.n == r.d == r.last + 1
    got = {r.value: (r.key, r.timestamp) for r in table.select("value", "key", F.unix_micros("timestamp").alias("timestamp")).collect()}
    want = {f"v{i}": (str(i) if i % 5 else None, T0_US + i * 1_000_000) for i in range(140)}
    assert got == want


def test_unbounded_stream_and_files_without_an_entry(spark):
    path, target, checkpoint = (shared_dir(spark, p) for p in ("log", "target", "checkpoint"))
    log = RecordLog(spark, path)
    assert log.records().count() == 0
    log.append(numbered(spark, 0, 50))
    # As if an append had died before its entry.
    numbered(spark, 50, 60).write.partitionBy("partition").parquet(f"{path}/data/dead")
    assert log.records().count() == 50
    assert sum(run(spark, path, target, checkpoint)) == 50
    log.append(numbered(spark, 0, 0))
    assert len(log.entries()) == 1
    with pytest.raises(Exception, match="without a partition"):
        log.append(numbered(spark, 0, 5).withColumn("partition", F.lit(None).cast("int")))
    with pytest.raises(ValueError):
        log_records(spark, path, 10)


def test_shares_of_a_bound():
    reader = LogStreamReader("/nowhere", 10, None)
    reader._refresh = lambda: None
    reader.ends = {"0": 1000, "1": 1, "2": 0}
    ends = [reader.latestOffset() for _ in range(200)]
    taken = [sum(e.values()) for e in ends]
    assert taken[:3] == [10, 20, 30] and taken[-1] == 1001 and ends[-1] == {"0": 1000, "1": 1}
    assert all(b - a <= 10 for a, b in zip(taken, taken[1:]))
