"""Merged sketches against plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators import sketches as m
from tests.helpers import plan

T0 = datetime(2024, 3, 10, tzinfo=timezone.utc)
STEP, LENGTH = timedelta(seconds=15), timedelta(seconds=60)


def rows_of(seed, n=300, span=1500):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b"]), T0 + timedelta(seconds=rng.randrange(span)), float(rng.randint(0, 9))) for _ in range(n)]
    return rows + [(None, T0, 1.0), ("a", None, 2.0), ("b", T0, None), ("b", T0, float("nan"))]


def windows(rows, keep):
    out = {}
    for k, ts, v in rows:
        if ts is not None and v is not None and keep(v):
            slot = int(ts.timestamp()) // 15 * 15
            for start in range(slot - 45, slot + 1, 15):
                out.setdefault((k, start * 1_000_000), []).append(v)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_hold_every_row_once(spark, seed):
    rows = rows_of(seed, span=[900, 9000][seed - 1])
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double")
    merged = m.over_windows(m.quantile_sketches(df, "ts", "v", ["k"], STEP), ["k"], m.merge_quantiles, LENGTH, STEP)
    got = {(r.k, r.window_start): (r.n, r.q) for r in merged.select(
        "k", "window_start", F.kll_sketch_get_n_double("sketch").alias("n"), m.quantile_of(F.col("sketch"), 0.5).alias("q")).collect()}
    want = windows(rows, lambda v: v == v)
    assert got.keys() == want.keys()
    for key, values in want.items():
        # Sets below k are kept whole, so the median is a value with half of the rows at or below it.
        n, q = got[key]
        assert n == len(values) and sum(v < q for v in values) <= n / 2 <= sum(v <= q for v in values) + 1e-9


def test_distinct_windows(spark):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "k string, ts timestamp, v double").withColumn("v", F.nanvl("v", F.lit(0.0)).cast("long"))
    rows = [(k, ts, None if v is None else 0 if v != v else v) for k, ts, v in rows]
    merged = m.over_windows(m.distinct_sketches(df, "ts", "v", ["k"], STEP), ["k"], m.merge_distinct, LENGTH, STEP)
    got = {(r.k, r.window_start): r.n for r in merged.select("k", "window_start", m.distinct_of(F.col("sketch")).alias("n")).collect()}
    assert got == {key: len(set(values)) for key, values in windows(rows, lambda v: True).items()}


def test_errors_stay_below_their_bounds(spark):
    n = 200_000
    df = spark.range(n).select(F.timestamp_micros(F.col("id") * 10_000_000).alias("ts"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("v"))
    day = timedelta(days=1)
    merged = m.over_range(m.quantile_sketches(df, "ts", "v", [], day), [], m.merge_quantiles)
    for q in (0.05, 0.5, 0.95, 0.99):
        estimate = merged.select(m.quantile_of(F.col("sketch"), q).alias("q")).first().q
        assert abs(df.filter(F.col("v") <= estimate).count() / n - q) < 0.015
    users = m.over_range(m.distinct_sketches(df, "ts", "v", [], day), [], m.merge_distinct).select(m.distinct_of(F.col("sketch")).alias("n")).first().n
    assert abs(users / n - 1) < 0.06


def test_range_and_empty(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=s), float(s)) for s in (0, 20, 40)], "k string, ts timestamp, v double")
    at = int(T0.timestamp()) * 1_000_000
    sketches = m.quantile_sketches(df, "ts", "v", ["k"], STEP)
    part = m.over_range(sketches, ["k"], m.merge_quantiles, at + 15_000_000, at + 30_000_000)
    assert part.select(F.kll_sketch_get_n_double("sketch")).first()[0] == 1
    none = m.quantile_sketches(df.filter("false"), "ts", "v", ["k"], STEP)
    assert m.over_windows(none, ["k"], m.merge_quantiles, LENGTH, STEP).count() == 0
    with pytest.raises(ValueError):
        m.over_windows(sketches, ["k"], m.merge_quantiles, timedelta(seconds=50), STEP)


def test_windows_merge_sketches_and_never_rows(spark):
    df = spark.createDataFrame(rows_of(4), "k string, ts timestamp, v double")
    text = plan(m.over_windows(m.quantile_sketches(df, "ts", "v", ["k"], STEP), ["k"], m.merge_quantiles, LENGTH, STEP))
    # Only times are copied to the windows that cover them; both running merges share one window's exchange.
    assert text.count("Window [") <= 2 and "Join" not in text
