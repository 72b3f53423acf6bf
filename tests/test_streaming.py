import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.histograms import QUERY_BOUNDS, latency_histogram
from emberlog.schema import RECORD_SCHEMA
from emberlog.sources.tables import LogTables
from emberlog.streaming.dedup import drop_redelivered, drop_redelivered_stream
from emberlog.streaming.ingest import ingest, run_batches
from emberlog.streaming.metrics import LateRows, counts_per_step, sliding_buckets
from emberlog.streaming.shedding import shed
from emberlog.streaming.sources import file_records
from tests.helpers import NOW, batch, logs
from tests.test_operators import T0, depth_series, fold


def put(spark, path, first, values):
    rows = [(None, v, 0, first + i, NOW + timedelta(seconds=first + i)) for i, v in enumerate(values)]
    spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def entry(ident):
    return json.dumps({"id": ident, "timestamp": "2024-03-10T11:00:00Z", "source": "api"})


def run(spark, tables, path, checkpoint, **options):
    query = ingest(file_records(spark, path, max_files=1), tables, checkpoint, available_now=True, **options)
    query.awaitTermination()
    return query


def test_restart_continues_after_the_checkpoint(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    tables = LogTables(spark, str(tmp_path / "tables"))
    put(spark, path, 0, [entry("a"), "broken", entry("b")])
    run(spark, tables, path, checkpoint)
    assert sorted(r.id for r in tables.hot().collect()) == ["a", "b"]
    assert [r.raw for r in tables.quarantine().collect()] == ["broken"]
    counts = tables.batches().first()
    assert (counts.input_rows, counts.accepted, counts.rejected) == (3, 2, 1)
    run(spark, tables, path, checkpoint)
    assert tables.hot().count() == 2
    put(spark, path, 10, [entry("c")])
    run(spark, tables, path, checkpoint)
    assert sorted(r.id for r in tables.hot().collect()) == ["a", "b", "c"]
    assert tables.committed_batch() == (0, 1)


def test_a_new_checkpoint_with_a_new_run_adds_to_the_table(spark, tmp_path):
    path = str(tmp_path / "in")
    tables = LogTables(spark, str(tmp_path / "tables"))
    put(spark, path, 0, [entry("a")])
    run(spark, tables, path, str(tmp_path / "cp0"))
    with pytest.raises(Exception, match="belongs to writer"):
        run(spark, tables, path, str(tmp_path / "cp0b"))
    assert tables.hot().count() == 1
    run(spark, tables, path, str(tmp_path / "cp1"), run=1)
    assert tables.hot().count() == 2


def test_missing_timestamp_takes_the_records(spark, tmp_path):
    path = str(tmp_path / "in")
    tables = LogTables(spark, str(tmp_path / "tables"))
    put(spark, path, 7, ['{"id":"a"}'])
    run(spark, tables, path, str(tmp_path / "cp"))
    assert tables.hot().select(F.unix_micros("timestamp")).first()[0] == int((NOW + timedelta(seconds=7)).timestamp()) * 1_000_000


def test_a_failed_batch_is_handed_over_again(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    put(spark, path, 0, [entry("a"), entry("b")])
    seen = []

    def failing(rows, batch_id):
        seen.append((batch_id, rows.count()))
        if len(seen) == 1:
            raise ValueError("handler failed")

    stream = file_records(spark, path)
    with pytest.raises(Exception):
        run_batches(stream, failing, checkpoint, available_now=True).awaitTermination()
    run_batches(file_records(spark, path), failing, checkpoint, available_now=True).awaitTermination()
    assert seen == [(0, 2), (0, 2)]


def test_dedup_across_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = logs(spark, batch(5, "api", NOW)).withColumn("partition", F.lit(0)).withColumn("offset", F.col("ingest_seq"))
    nameless = rows.withColumn("id", F.lit("")).withColumn("offset", F.col("offset") + 500)
    for shift in (0, 100):
        rows.unionByName(rows).unionByName(nameless).withColumn("offset", F.col("offset") + shift).coalesce(1).write.mode(
            "append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    (drop_redelivered_stream(stream).drop("labels").writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    kept = spark.read.parquet(out)
    assert sorted(r.id for r in kept.filter("id <> ''").collect()) == [f"api-{i}" for i in range(5)]
    assert kept.filter("id = ''").count() == 10


def test_late_rows_are_deduplicated_not_dropped(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    for ident, at in (("a", NOW), ("b", NOW - timedelta(hours=49)), ("c", NOW), ("b", NOW - timedelta(hours=49))):
        logs(spark, [(ident, at, "s", "INFO", "m", None, None, None)]).drop("labels").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    (drop_redelivered_stream(stream).writeStream.format("parquet").option("path", target)
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_late_rows_of_counts_are_counted(spark, tmp_path):
    path = str(tmp_path / "in")
    for at in (NOW, NOW, NOW - timedelta(hours=49)):
        logs(spark, [("x", at, "s", "INFO", "m", None, None, None)]).drop("labels").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    late = LateRows()
    spark.streams.addListener(late)
    try:
        query = (counts_per_step(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(late)
    assert late.dropped[str(query.id)] == 1


def test_batch_dedup_keeps_the_first(spark):
    rows = logs(spark, batch(3, "a", NOW), batch(3, "a", NOW + timedelta(seconds=1)))
    kept = drop_redelivered(rows.drop("labels"))
    assert sorted(r.ingest_seq for r in kept.collect()) == [0, 1, 2]


def test_sliding_buckets_equal_a_batch_over_finished_windows(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(T0 + timedelta(seconds=i * 7), "hot" if i % 3 else "cold", (i % 40) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "ts timestamp, tier string, seconds double")
    df.coalesce(1).write.parquet(path)
    late = [(T0 + timedelta(days=2), "hot", 0.1)]
    spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)
    buckets = sliding_buckets(stream, "ts", "seconds", QUERY_BOUNDS, ["tier"], delay="1 hour")
    (buckets.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    window = F.window("ts", "5 minutes", "15 seconds")
    expected = latency_histogram(df, "seconds", QUERY_BOUNDS, [window.alias("w"), "tier"])
    want = {(r.us, r.tier, r.le): r["count"] for r in expected.select(F.unix_micros("w.start").alias("us"), "tier", "le", "count").collect()}
    got = {(r.us, r.tier, r.le): r["count"] for r in spark.read.parquet(out).withColumn("us", F.unix_micros("window_start")).collect()}
    assert got == want


def test_shedding_state_is_carried_between_batches(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    series = {k: depth_series(i, 120) for i, k in enumerate("ab")}
    schema = "ingestor string, seq long, us long, depth long"
    for start in range(0, 120, 40):
        part = [(k, *r) for k, rows in series.items() for r in rows[start:start + 40] if not (k == "b" and start == 40)]
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
        frame.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    cool = timedelta(seconds=30)
    shed(stream, out, str(tmp_path / "cp"), 100, cool, available_now=True).awaitTermination()
    got = {(r.ingestor, r.seq): (r.accept, r.engaged_us) for r in spark.read.parquet(f"{out}/states").collect()}
    kept = {k: [r for r in rows if not (k == "b" and 40 <= r[0] < 80)] for k, rows in series.items()}
    assert got == {(k, s): (a, e) for k, rows in kept.items() for s, a, e in fold(rows, 100, 30_000_000)}
