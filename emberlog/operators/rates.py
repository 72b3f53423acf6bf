"""Rates and sliding windows.

Rows are first summed into slots of one step, and only those sums are copied to the windows that
cover them. A window [start, start + length) is evaluated at every multiple of the step, as Spark's
own `window` does; there is no extrapolation to the window's edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros
from emberlog.operators.histograms import INF, histogram_quantile, quantile_of_counts
from emberlog.operators.ordered import density_block, previous
from emberlog.schema import EVALUATION_STEP, RATE_WINDOW


def _us(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def slot_start(ts: Column, step: timedelta) -> Column:
    """Start of the step that holds `ts`, in microseconds."""
    return (F.floor(as_micros(ts) / F.lit(_us(step))) * F.lit(_us(step))).cast("long")


def sliding_sums(slotted: DataFrame, by: Sequence[str], sums: Sequence[str], length: timedelta, step: timedelta) -> DataFrame:
    """Sums per window from rows already summed per slot (`slot`, microseconds)."""
    if _us(length) % _us(step):
        raise ValueError("length must be a multiple of step")
    starts = F.sequence(
        F.col("slot") - F.lit(_us(length) - _us(step)), F.col("slot"), F.lit(_us(step)).cast("long"))
    spread = slotted.withColumn("window_start", F.explode(starts))
    return spread.groupBy(*by, "window_start").agg(*[F.sum(c).alias(c) for c in sums])


def event_rate(df: DataFrame, ts: str, by: Sequence[str], length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Events per second in every sliding window that holds one; `window_start` is in microseconds."""
    slotted = df.groupBy(*by, slot_start(F.col(ts), step).alias("slot")).agg(F.count(F.lit(1)).alias("events"))
    windows = sliding_sums(slotted, by, ["events"], length, step)
    return windows.withColumn("rate", F.col("events") / F.lit(length.total_seconds()))


def counter_increments(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value",
                       tie_break: Sequence[str] = ()) -> DataFrame:
    """Increase of a counter since the previous sample of its series; a smaller value is a restart from zero."""
    stepped = previous(samples, series, [ts, *tie_break], [value], density_block(samples, series, ts))
    before = F.col(f"prev_{value}")
    increase = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return stepped.withColumn("increase", F.coalesce(increase, F.lit(0.0))).drop(f"prev_{value}")


def counter_rate(samples: DataFrame, series: Sequence[str], ts: str = "ts", value: str = "value",
                 length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP,
                 tie_break: Sequence[str] = ()) -> DataFrame:
    """Increase per second in every sliding window, restarts included."""
    grown = counter_increments(samples, series, ts, value, tie_break)
    slotted = grown.groupBy(*series, slot_start(F.col(ts), step).alias("slot")).agg(F.sum("increase").alias("increase"))
    windows = sliding_sums(slotted, series, ["increase"], length, step)
    return windows.withColumn("rate", F.col("increase") / F.lit(length.total_seconds()))


def sliding_quantile(df: DataFrame, ts: str, value: str, bounds: Sequence[float], by: Sequence[str], q: float = 0.95,
                     length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Histogram quantile of the observations in every sliding window, from raw observations."""
    edges = [*bounds, INF]
    names = [f"_b{i}" for i in range(len(edges))]
    slotted = df.groupBy(*by, slot_start(F.col(ts), step).alias("slot")).agg(*[
        F.count_if(F.col(value) <= F.lit(edge)).alias(name) for edge, name in zip(edges, names)])
    windows = sliding_sums(slotted, by, names, length, step)
    return windows.select(
        *by, "window_start", quantile_of_counts([F.col(n) for n in names], edges, q).alias("quantile"))


def bucket_rate_quantile(samples: DataFrame, by: Sequence[str], series: Sequence[str], q: float = 0.95,
                         length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Quantile of summed bucket rates: samples of cumulative bucket counters with an `le` column.

    `series` names the labels that tell one counter from another (without `le`); `by` is the part of
    them that is kept.
    """
    rates = counter_rate(samples, [*series, "le"], length=length, step=step)
    summed = rates.groupBy(*by, "window_start", "le").agg(F.sum("rate").alias("rate"))
    return histogram_quantile(summed, q, [*by, "window_start"], count="rate")
