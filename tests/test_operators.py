"""Block-wise operators, quantiles, alerts and shedding against plain Python on small random series."""

import math
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators.alerts import hold_for
from emberlog.operators.backpressure import _Block, dropped, hysteresis, running_depth, transitions
from emberlog.operators.counters import active_partitions, consumer_lag
from emberlog.operators.histograms import (
    INF, QUERY_BOUNDS, approximate_quantile, exponential_bounds, floor_rank_quantile, histogram_quantile,
    latency_histogram,
)
from emberlog.operators.ordered import density_block, global_rank, previous, running_max, running_sum, seq_block, time_block
from emberlog.operators.rates import counter_increments, counter_rate, event_rate
from emberlog.operators.reconcile import lost, reconcile, totals
from tests.helpers import plan

T0 = datetime(2024, 3, 10, tzinfo=timezone.utc)


def series(seed, keys=3, n=200):
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 1, 5, 40])
        rows.append((rng.choice(["a", "a", "a", "b", "c"][: keys + 2]), seq, rng.randint(-20, 20)))
    return rows


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_running_sum_and_previous_across_blocks(spark, size):
    rows = series(size)
    df = spark.createDataFrame(rows, "k string, seq long, v long")
    block = seq_block("seq", size)
    sums = {(r.k, r.seq): r.s for r in running_sum(df, ["k"], "seq", "v", "s", block).collect()}
    tops = {(r.k, r.seq): r.m for r in running_max(df, ["k"], ["seq"], "v", "m", block).collect()}
    before = {(r.k, r.seq): r.prev_v for r in previous(df, ["k"], ["seq"], ["v"], block).collect()}
    assert len(sums) == len(tops) == len(before) == len(rows)
    seen = {}
    for k, seq, v in rows:
        earlier = seen.setdefault(k, [])
        assert before[k, seq] == (earlier[-1] if earlier else None)
        earlier.append(v)
        assert sums[k, seq] == sum(earlier)
        assert tops[k, seq] == max(earlier)


@pytest.mark.parametrize("step_us", [1_000, 3_600_000_000])
def test_blocks_follow_the_density(spark, step_us):
    """A burst within five minutes and a sample per hour both make several blocks of many rows."""
    df = spark.range(2_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * step_us).alias("ts"), "id")
    sizes = [r["count"] for r in df.groupBy(density_block(df, ["k"], "ts", 200).alias("b")).count().collect()]
    assert 9 <= len(sizes) <= 12 and max(sizes) <= 210
    stepped = previous(df, ["k"], ["ts"], ["id"], density_block(df, ["k"], "ts", 200))
    assert stepped.filter("coalesce(prev_id, -1) <> id - 1").count() == 0


def test_sparse_series_do_not_cut_dense_ones(spark):
    """One sample of another series leaves the blocks of a dense one as they are."""
    dense = spark.range(2_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 15_000_000).alias("ts"), "id")
    both = dense.unionByName(spark.range(1).select(F.lit("single").alias("k"), F.timestamp_micros(F.lit(7)).alias("ts"), "id"))
    sizes = [r["count"] for r in both.groupBy("k", density_block(both, ["k"], "ts", 200).alias("b")).count().collect()]
    assert 10 <= len(sizes) <= 13 and max(sizes) <= 210
    # Nothing needs cutting: one block.
    assert both.select(density_block(both, ["k"], "ts").alias("b")).distinct().count() == 1


def test_a_burst_inside_a_long_span_is_cut(spark):
    burst = spark.range(4_000).select(F.lit("k").alias("k"), F.timestamp_micros(F.when(F.col("id") < 2_000, F.col("id") * 3_600_000_000)
                                                                               .otherwise(5_000_000_000_000 + F.col("id") * 1_000)).alias("ts"), "id")
    sizes = [r["count"] for r in burst.groupBy(density_block(burst, ["k"], "ts", 200).alias("b")).count().collect()]
    assert max(sizes) <= 4 * 200 and sum(sizes) == 4_000


def test_plans_read_their_input_twice_at_most(spark, tmp_path):
    """The lag series, the alert over it and the shedding alert go back to the samples no more often than a shift needs."""
    from emberlog.workload import alerts

    sf = "/root/testdata/sf0.001"
    for name, scans in (("consumer_lag_series", 2), ("alert_consumer_lag", 2), ("alert_backpressure", 2), ("shedding_dropped", 1)):
        text = plan(getattr(alerts, name)(spark, sf))
        assert text.count("events.parquet") <= scans, name
        assert name.startswith("consumer_lag") or "FlatMapGroupsInPandas" not in text


def test_global_rank(spark):
    rows = sorted({seq for _, seq, _ in series(5)})
    df = spark.createDataFrame([(s,) for s in rows], "seq long").repartition(4)
    ranked = {r.seq: r.rank for r in global_rank(df, "seq", "rank", 16).collect()}
    assert ranked == {s: i + 1 for i, s in enumerate(rows)}


def test_a_hot_key_is_windowed_in_blocks(spark):
    df = spark.createDataFrame(series(1), "k string, seq long, v long")
    text = plan(running_sum(df, ["k"], "seq", "v", "s", seq_block("seq", 10)))
    assert "hashpartitioning(k" in text and "_block" in text


def floor_rank(values, q=0.95):
    return sorted(values)[max(math.floor(len(values) * q), 1) - 1]


@pytest.mark.parametrize("seed", range(3))
def test_floor_rank_quantile(spark, seed):
    rng = random.Random(seed)
    groups = {
        "one": [3.5], "ties": [1.0] * 50 + [2.0] * 50, "wide": [10 ** rng.uniform(-9, 9) for _ in range(300)],
        "signed": [rng.uniform(-5, 5) for _ in range(333)], "zero": [0.0] * 7, "close": [1 + i * 1e-12 for i in range(100)],
        "inf": [1.0] * 5 + [INF] * 5, "negative": [-10 ** rng.uniform(-3, 3) for _ in range(40)],
    }
    groups[None] = [2.0, 7.0, 9.0]
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.95, 0.5, 0.01):
        got = {r.k: r.quantile for r in floor_rank_quantile(df, "v", ["k"], q, slots=8).collect()}
        assert got == {k: floor_rank(vs, q) for k, vs in groups.items()}


def test_floor_rank_of_twenty_is_the_nineteenth(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(1, 21)], "k string, v double")
    assert floor_rank_quantile(df, "v", ["k"]).first().quantile == 19.0
    assert approximate_quantile(df, "v", ["k"]).first().quantile == 19.0


def test_bounds():
    assert exponential_bounds(0.001, 2, 4) == [0.001, 0.002, 0.004, 0.008]
    assert len(QUERY_BOUNDS) == 14


def test_histogram_is_cumulative_and_inclusive(spark):
    df = spark.createDataFrame([(v,) for v in (0.1, 0.2, 0.20001, 5.0)], "v double")
    rows = {r.le: r["count"] for r in latency_histogram(df, "v", [0.1, 0.2, 0.4]).collect()}
    assert rows == {0.1: 1, 0.2: 2, 0.4: 3, INF: 4}


def test_histogram_quantile(spark):
    def quantile(counts, q=0.95):
        rows = [("g", le, c) for le, c in counts]
        return histogram_quantile(spark.createDataFrame(rows, "g string, le double, count long"), q, ["g"]).first().quantile
    assert quantile([(1.0, 0), (2.0, 10), (INF, 10)], 0.5) == pytest.approx(1.5)
    assert quantile([(1.0, 4), (2.0, 4), (INF, 4)], 0.5) == pytest.approx(0.5)
    # The rank falls into the +Inf bucket: the highest finite bound.
    assert quantile([(1.0, 1), (2.0, 2), (INF, 100)]) == 2.0
    assert quantile([(1.0, 0), (INF, 0)]) is None


def test_counter_restarts(spark):
    rows = [("a", T0 + timedelta(seconds=15 * i), v) for i, v in enumerate([5.0, 7.0, 2.0, 2.0, 10.0])]
    df = spark.createDataFrame(rows, "s string, ts timestamp, value double")
    grown = counter_increments(df, ["s"]).orderBy("ts").collect()
    assert [r.increase for r in grown] == [0.0, 2.0, 2.0, 0.0, 8.0]
    rates = {r.window_start: r.rate for r in counter_rate(df, ["s"]).collect()}
    # The window that starts with the first sample holds all of them.
    assert rates[int(T0.timestamp()) * 1_000_000] == pytest.approx(12.0 / 300)


def test_event_rate_equals_spark_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), T0 + timedelta(seconds=rng.uniform(0, 3000))) for _ in range(300)]
    df = spark.createDataFrame(rows, "s string, ts timestamp")
    plain = df.groupBy(F.window("ts", "5 minutes", "15 seconds").alias("w"), "s").count()
    expected = {(r.s, r.us, r["count"]) for r in plain.select("s", F.unix_micros("w.start").alias("us"), "count").collect()}
    got = {(r.s, r.window_start, r.events) for r in event_rate(df, "ts", ["s"]).collect()}
    assert got == expected


def test_lag(spark):
    rows = [(T0, "g", 0, 100, 10), (T0 + timedelta(seconds=1), "g", 0, 100, 99), (T0, "g", 1, 5, 9), (T0, "h", 0, 50, 9)]
    df = spark.createDataFrame(rows, "ts timestamp, consumer_group string, partition int, high_water_mark long, offset long")
    assert {(r.consumer_group, r.partition): r.lag for r in consumer_lag(df).collect()} == {
        ("g", 0): 0, ("g", 1): 0, ("h", 0): 40}
    assert {r.consumer_group: r.active_partitions for r in active_partitions(df).collect()} == {"g": 2, "h": 1}


def test_reconcile(spark):
    sent = spark.createDataFrame([(f"failover-{i}",) for i in range(1, 301)] + [("failover-1",)], "id string")
    stored = spark.createDataFrame(
        [(f"failover-{i}",) for i in range(1, 247)] + [("failover-5",)] * 54 + [("other",)], "id string")
    row = totals(reconcile(sent, stored)).first()
    # The 54 extra copies hide the 54 losses from a plain count.
    assert (row.sent, row.recovered, row.lost, row.redelivered, row.extra_copies) == (300, 246, 54, 1, 54)
    nameless = spark.createDataFrame([("",), ("",), (None,), ("a",)], "id string")
    assert [r.id for r in reconcile(nameless, nameless).collect()] == ["a"]
    assert lost(nameless, stored).count() == 1


def hold_python(rows, hold_us, gap_us):
    out, since, last = {}, {}, {}
    for key, us, seq, cond in sorted(rows, key=lambda r: (r[1], r[2])):
        if gap_us is not None and us - last.get(key, us) > gap_us:
            since[key] = None
        last[key] = us
        since[key] = (since.get(key) if since.get(key) is not None else us) if cond else None
        out[key, seq] = (cond, None if since[key] is None else us - since[key],
                         since[key] is not None and us - since[key] >= hold_us)
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("seconds", [20, 300, 3600])
@pytest.mark.parametrize("gap", [None, 150, 700])
def test_hold_for(spark, seed, seconds, gap):
    rng = random.Random(seed)
    rows, us = [], 0
    for seq in range(300):
        us += rng.choice([0, 15, 15, 15, 200, 900]) * 1_000_000
        rows.append((rng.choice("aab"), us, seq, rng.random() < (0.8, 0.97, 0.3, 1.0)[seed]))
    df = spark.createDataFrame(rows, "k string, us long, seq long, cond boolean").withColumn("ts", F.timestamp_micros("us"))
    judged = hold_for(df, ["k"], ["ts", "seq"], F.col("cond"), timedelta(minutes=5), block=time_block("ts", seconds),
                      max_gap=None if gap is None else timedelta(seconds=gap)).collect()
    assert {(r.k, r.seq): (r.active, r.held_us, r.firing) for r in judged} == hold_python(rows, 300_000_000, gap and gap * 1_000_000)


def fold(rows, max_depth, cooldown_us, engaged=None):
    """One ingestor's states, check by check."""
    out = []
    for seq, us, depth in rows:
        accept = depth <= max_depth
        if not accept:
            engaged = us if engaged is None else engaged
        elif engaged is not None and depth < max_depth // 2 and us - engaged > cooldown_us:
            engaged = None
        out.append((seq, accept, engaged))
    return out


def depth_series(seed, n=400, flat=False):
    rng = random.Random(seed)
    rows, us = [], 0
    for seq in range(n):
        us += rng.choice([0, 1, 5, 30] if flat else [0, 1, 5, 30, 120]) * 1_000_000
        rows.append((seq, us, rng.choice([0, 20, 49, 50, 51, 99, 100, 101, 150])))
    return rows


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("size", [1, 3, 10, 50, 1000])
def test_block_summaries_chain_to_the_fold(seed, size):
    """The state before every block, from summaries alone, is the state the plain fold has there."""
    import pandas as pd
    rows = depth_series(seed)
    expected = fold(rows, 100, 30_000_000)
    engaged = None
    for start in range(0, len(rows), size):
        part = rows[start:start + size]
        assert engaged == (expected[start - 1][2] if start else None)
        blk = _Block(pd.DataFrame(part, columns=["_seq", "_us", "_depth"]), 100, 30_000_000)
        idle, bounds, exits = blk.summary()
        entry = engaged
        if engaged is None:
            engaged = idle
        else:
            for bound, after in zip(bounds, exits):
                if engaged + 30_000_000 < bound:
                    engaged = after
                    break
        assert blk.intervals(entry)[1] == engaged


@pytest.mark.parametrize("size", [5, 64])
def test_hysteresis_over_blocks(spark, size):
    all_rows = {k: depth_series(i, 300) for i, k in enumerate("abc")}
    flat = [(k, *r) for k, rows in all_rows.items() for r in rows]
    df = spark.createDataFrame(flat, "ingestor string, seq long, us long, depth long").withColumn("ts", F.timestamp_micros("us"))
    states = hysteresis(df, 100, timedelta(seconds=30), block=F.floor(F.col("seq") / size))
    got = {(r.ingestor, r.seq): (r.accept, r.engaged_us, r.active) for r in states.collect()}
    expected = {(k, s): (a, e, e is not None) for k, rows in all_rows.items() for s, a, e in fold(rows, 100, 30_000_000)}
    assert got == expected
    changes = transitions(states, block=F.floor(F.col("seq") / size)).orderBy("ingestor", "seq").collect()
    for k in "abc":
        events = [r.event for r in changes if r.ingestor == k]
        assert events[:2] == ["engaged", "released"] and all(x != y for x, y in zip(events, events[1:]))
    rejected = {r.ingestor: r.dropped for r in dropped(df, 100).collect()}
    assert rejected == {k: sum(d > 100 for _, _, d in rows) for k, rows in all_rows.items()}


def check(spark, steps, max_depth=100, cooldown=timedelta(seconds=1)):
    rows = [("i", n, T0 + timedelta(milliseconds=ms), depth) for n, (ms, depth) in enumerate(steps)]
    df = spark.createDataFrame(rows, "ingestor string, seq long, ts timestamp, depth long")
    last = hysteresis(df, max_depth, cooldown).orderBy("seq").collect()[-1]
    return last.accept, last.active


def test_shedding_cases(spark):
    assert check(spark, [(0, 50)]) == (True, False)
    assert check(spark, [(0, 150)]) == (False, True)
    assert check(spark, [(0, 150), (80, 30)], cooldown=timedelta(milliseconds=50)) == (True, False)
    assert check(spark, [(0, 150), (80, 30)], cooldown=timedelta(seconds=10)) == (True, True)
    # Exactly the maximum is accepted, exactly half the maximum does not release, exactly the cooldown neither.
    assert check(spark, [(0, 100)]) == (True, False)
    assert check(spark, [(0, 150), (5000, 50)]) == (True, True)
    assert check(spark, [(0, 150), (1000, 30)]) == (True, True)


def test_running_depth(spark):
    rows = [("i", 0, 5), ("i", 1, -2), ("j", 0, 1), ("i", 2, 4)]
    df = spark.createDataFrame(rows, "ingestor string, seq long, delta long")
    got = {(r.ingestor, r.seq): r.depth for r in running_depth(df, block=F.col("seq")).collect()}
    assert got == {("i", 0): 5, ("i", 1): 3, ("i", 2): 7, ("j", 0): 1}
