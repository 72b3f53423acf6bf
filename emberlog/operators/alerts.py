"""Alerts that fire once a condition has held without a break for a given time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros
from emberlog.operators.ordered import BLOCK, density_block, order_key
from emberlog.schema import STALE_AFTER


@dataclass(frozen=True)
class AlertRule:
    name: str
    severity: str
    threshold: float
    hold: timedelta
    # "above" compares value > threshold, "equal" compares value == threshold
    compare: str = "above"

    def condition(self, value: Column) -> Column:
        met = value > F.lit(self.threshold) if self.compare == "above" else value == F.lit(self.threshold)
        return F.coalesce(met, F.lit(False))


# Fixed rules.
HIGH_QUERY_LATENCY = AlertRule("HighQueryLatency", "warning", 0.5, timedelta(minutes=5))
CONSUMER_LAG_GROWING = AlertRule("ConsumerLagGrowing", "critical", 100_000, timedelta(minutes=3))
BACKPRESSURE_ENGAGED = AlertRule("BackpressureEngaged", "warning", 1, timedelta(minutes=2), "equal")


def hold_for(samples: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column, hold: timedelta,
             ts: str = "ts", block: Column | None = None, max_gap: timedelta | None = STALE_AFTER) -> DataFrame:
    """Per sample: is the condition met, how long has it held, and is the alert firing.

    `order` starts with the time column and must be unique within a key; keys must not be null. The samples are read a few
    times, so settle them if they are derived at some cost. Adds
    `active`, `held_us` and `firing`. A gap of more than `max_gap` between two samples of a key ends what held before it
    (None: gaps never do). Runs are found inside time blocks; a run that is open at the end of a block is carried into
    the next ones until an unmet sample or a gap ends it.
    """
    at = as_micros(F.col(ts))
    marked = samples.withColumn("active", F.coalesce(condition, F.lit(False))).withColumn(
        BLOCK, density_block(samples, keys, ts) if block is None else block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    longest = None if max_gap is None else max_gap // timedelta(microseconds=1)

    def gap(now: Column, before: Column) -> Column:
        return F.lit(False) if longest is None else F.coalesce(now - before > F.lit(longest), F.lit(False))

    local = (marked.withColumn("_gap", gap(at, F.lag(at).over(inside)))
             .withColumn("_begin", F.when(F.col("active") & (F.col("_gap") | ~F.coalesce(F.lag("active").over(inside), F.lit(False))), at))
             .withColumn("_start", F.max("_begin").over(so_far))
             .withColumn("_broken", F.max(~F.col("active") | F.col("_gap")).over(so_far)))

    ends = local.groupBy(*keys, BLOCK).agg(
        F.max(F.col("_broken").cast("int")).alias("_broken"), F.min(at).alias("_first"), F.max(at).alias("_last"),
        F.max_by(F.when(F.col("active"), F.col("_start")), order_key(samples, order)).alias("_open"))
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    stretch = Window.partitionBy(*keys, "_stretch").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    # A stretch is a block with an unmet sample or after a gap, and the fully met blocks after it: its first open run goes on.
    carried = (ends.withColumn("_gap", gap(F.col("_first"), F.lag("_last").over(by_block)))
               .withColumn("_stretch", F.sum(F.greatest(F.col("_broken"), F.col("_gap").cast("int"))).over(by_block))
               .withColumn("_out", F.min("_open").over(stretch))
               .select(*keys, BLOCK, F.when(~F.col("_gap"), F.lag("_out").over(by_block)).alias("_carry")))

    joined = local.join(carried, [*keys, BLOCK], "left")
    since = F.when(F.col("_broken"), F.col("_start")).otherwise(F.coalesce("_carry", "_start"))
    limit = F.lit(hold // timedelta(microseconds=1))
    return joined.withColumn("held_us", F.when(F.col("active"), at - since)).select(
        *samples.columns, *[c for c in ("active", "held_us") if c not in samples.columns],
        F.coalesce(F.col("held_us") >= limit, F.lit(False)).alias("firing"))


def evaluate(rule: AlertRule, samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value",
             ts: str = "ts", max_gap: timedelta | None = STALE_AFTER, block: Column | None = None) -> DataFrame:
    """`hold_for` with a named rule; adds `alert` and `severity`."""
    judged = hold_for(samples, keys, order, rule.condition(F.col(value)), rule.hold, ts, block, max_gap)
    return judged.withColumn("alert", F.lit(rule.name)).withColumn("severity", F.lit(rule.severity))


def high_query_latency(p95: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value",
                       max_gap: timedelta | None = STALE_AFTER) -> DataFrame:
    """95th percentile query latency above 500 ms for five minutes."""
    return evaluate(HIGH_QUERY_LATENCY, p95, keys, order, value, max_gap=max_gap)


def consumer_lag_growing(lag: DataFrame, order: Sequence[str] = ("ts",), value: str = "lag",
                         max_gap: timedelta | None = STALE_AFTER) -> DataFrame:
    """Lag of a consumer group, summed over its partitions (`counters.lag_series`), above 100,000 for three minutes."""
    return evaluate(CONSUMER_LAG_GROWING, lag, ["consumer_group"], order, value, max_gap=max_gap)


def backpressure_engaged(state: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "active",
                         max_gap: timedelta | None = STALE_AFTER) -> DataFrame:
    """Load shedding active for two minutes; `value` is 0 or 1."""
    return evaluate(BACKPRESSURE_ENGAGED, state, keys, order, value, max_gap=max_gap)
