"""Streams that judge samples in event time, against the batch operators, over late samples, restarts and idle series."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.alerts import AlertRule, evaluate
from emberlog.operators.rates import counter_rate
from emberlog.streaming.alerts import stream_alerts
from emberlog.streaming.delivery import delivery
from emberlog.streaming.rates import counter_slots, rates_of_slots
from tests.helpers import NOW

MINUTE = timedelta(minutes=1)
RULE = AlertRule("Slow", "warning", 10, 5 * MINUTE)
SCHEMA = "k string, seq long, ts timestamp, value double"


def run(spark, tmp_path, rows, files, transform, schema, restart=False):
    """The rows as files in order of arrival, one per batch; a last row far in the future ends every series."""
    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    per_file = -(-len(rows) // files)
    written = [rows[i:i + per_file] for i in range(0, len(rows), per_file)]
    written.append([("end", -1, NOW + timedelta(days=90), 0.0)])

    def job():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        (transform(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())

    for i, part in enumerate(written):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if restart and i == len(written) // 2:
            job()
    job()
    return spark.read.schema(schema).parquet(target)


def samples(seed, n=400, late=8):
    rng = random.Random(seed)
    rows = []
    for k in "abc":
        at = NOW
        for i in range(n):
            at += rng.choice([MINUTE / 4, MINUTE, 2 * MINUTE, 7 * MINUTE if rng.random() < 0.2 else MINUTE])
            rows.append((k, i, at, float(rng.choice([3, 12, 12, 12, 20]) if rng.random() < 0.93 else 1)))
    # Each sample arrives up to `late` minutes after its time.
    return sorted(rows, key=lambda r: r[2] + rng.random() * late * MINUTE)


ALERTS = "k string, kind string, seq long, us long, active boolean, held_us long, firing boolean, alert string, severity string"


@pytest.mark.parametrize("restart", [False, True])
def test_alerts_equal_the_batch_operator(spark, tmp_path, restart):
    rows = samples(1)
    found = run(spark, tmp_path, rows, 4, lambda s: stream_alerts(s, RULE, ["k"], delay="30 minutes"), ALERTS, restart)
    batch = evaluate(RULE, spark.createDataFrame(rows, SCHEMA), ["k"], ["ts", "seq"])
    expected = sorted((r.k, r.seq, r.active, r.held_us or 0, r.firing) for r in batch.collect())
    assert sorted((r.k, r.seq, r.active, r.held_us or 0, r.firing) for r in found.filter("kind = 'sample'").collect()) == expected
    # Every run that lasts long enough fires once: by a sample at that very moment, or by a timer.
    assert found.filter("kind = 'timer'").count() > 0


def one_series(*steps):
    return [("a", i, NOW + minutes * MINUTE, float(value)) for i, (minutes, value) in enumerate(steps)]


@pytest.mark.parametrize("steps, fired", [
    ([(0, 20), (2, 20), (4, 20)], [5]),  # nothing comes after minute 4, and the series is not stale at 5
    ([(0, 20), (2, 20), (4, 20), (4.5, 1)], []),  # it ended before
    ([(0, 20), (2, 20), (5, 1)], []),  # and ends at that moment
    ([(0, 20), (2, 20), (5, 20)], []),  # a sample at that moment fires itself
    ([(0, 20)], [5]),  # stale only after five minutes without a sample
    ([(0, 20), (6, 20), (8, 20)], [5, 11]),  # a gap of six minutes begins a new run
    ([(0, 1)], []),
])
def test_timers_need_no_next_sample(spark, tmp_path, steps, fired):
    found = run(spark, tmp_path, one_series(*steps), len(steps), lambda s: stream_alerts(s, RULE, ["k"], delay="1 minute"), ALERTS)
    timers = found.filter("kind = 'timer'").select(((F.col("us") - F.lit(int(NOW.timestamp()) * 1_000_000)) / 60_000_000).alias("m")).collect()
    assert sorted(r.m for r in timers) == fired


def test_late_samples_take_no_part_and_nulls_meet_nothing(spark, tmp_path):
    rows = one_series((0, 20), (1, 20)) + [("a", 8, None, 20.0), ("b", 9, NOW, None)] + one_series((60, 1), (61, 1)) + [("a", 7, NOW + 2 * MINUTE, 1.0)]
    found = run(spark, tmp_path, rows, len(rows), lambda s: stream_alerts(s, RULE, ["k"], delay="5 minutes"), ALERTS)
    judged = found.filter("kind = 'sample'").collect()
    assert sorted((r.seq, r.active) for r in judged) == [(0, False), (0, True), (1, False), (1, True), (9, False)]


def test_rates_equal_the_batch_operator(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for k in "ab":
        value = 0.0
        for i in range(300):
            value = rng.random() * 5 if rng.random() < 0.05 else value + rng.randint(0, 9)
            rows.append((k, i, NOW + i * MINUTE / 3 + (30 * MINUTE if i > 200 else 0 * MINUTE), value))
    rows.sort(key=lambda r: r[2] + rng.random() * 8 * MINUTE)
    options = {"length": 5 * MINUTE, "step": MINUTE}
    slots = run(spark, tmp_path, rows, 5, lambda s: counter_slots(s, ["k"], delay="20 minutes", step=MINUTE), "k string, slot long, increase double")
    got = {(r.k, r.window_start): round(r.rate, 9) for r in rates_of_slots(slots, ["k"], **options).collect()}
    batch = counter_rate(spark.createDataFrame(rows, SCHEMA), ["k"], tie_break=["seq"], **options)
    assert got == {(r.k, r.window_start): round(r.rate, 9) for r in batch.collect()}
    # A step comes out once.
    assert slots.count() == slots.select("k", "slot").distinct().count()


def test_delivery_within_the_time(spark, tmp_path):
    def at(minutes):
        return NOW + minutes * MINUTE

    sent = [("a", at(0)), ("b", at(1)), ("c", at(2)), ("d", at(3)), ("", at(3)), (None, at(4)), ("end", at(9999))]
    stored = [("a", at(5)), ("b", at(40)), ("c", at(1)), ("d", at(3)), ("d", at(13)), ("", at(5)), (None, at(5)), ("end", at(9999))]
    streams = []
    for name, rows in (("sent", sent), ("stored", stored)):
        path = str(tmp_path / name)
        for part in (rows[:3], rows[3:-1], rows[-1:]):
            spark.createDataFrame(part, f"id string, {name}_at timestamp").coalesce(1).write.mode("append").parquet(path)
        streams.append(spark.readStream.schema(f"id string, {name}_at timestamp").option("maxFilesPerTrigger", 1).parquet(path))
    target = str(tmp_path / "out")
    (delivery(*streams, within="10 minutes").writeStream.format("parquet").option("path", target).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    found = spark.read.schema("id string, sent_at timestamp, stored_at timestamp").parquet(target).collect()
    # b comes too late and c before it was sent; d comes twice in time.
    assert sorted((r.id, r.stored_at is None) for r in found) == [("a", False), ("b", True), ("c", True), ("d", False), ("d", False), ("end", False)]
