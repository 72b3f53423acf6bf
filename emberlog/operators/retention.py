"""Age splits: what a compaction drains, what an eviction discards, how late a row is."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros, column_type, micros, time_literal, utc
from emberlog.schema import COLD_AGE, HOT_RETENTION


def split_by_age(df: DataFrame, cutoff: datetime | str) -> tuple[DataFrame, DataFrame]:
    """(rows strictly before the cutoff, all others). Rows without a timestamp never age."""
    before = F.coalesce(F.col("timestamp") < time_literal(cutoff, column_type(df, "timestamp")), F.lit(False))
    return df.filter(before), df.filter(~before)


def drain(df: DataFrame, as_of: datetime | str, cold_age: timedelta = COLD_AGE) -> tuple[DataFrame, DataFrame]:
    """(rows to move to cold, rows that stay hot)."""
    return split_by_age(df, utc(as_of) - cold_age)


def evict(df: DataFrame, as_of: datetime | str, retention: timedelta = HOT_RETENTION) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): both sides are returned, so that what is discarded can be seen."""
    evicted, kept = split_by_age(df, utc(as_of) - retention)
    return kept, evicted


def lateness(df: DataFrame, as_of: datetime | str, cold_age: timedelta = COLD_AGE,
             retention: timedelta = HOT_RETENTION) -> DataFrame:
    """Add `late_us` (arrival minus timestamp) and its class.

    `on_time` stays hot, `late` is moved at the next compaction, `expired` is past retention and is
    discarded by an eviction unless a compaction comes first.
    """
    now = micros(as_of)
    late_us = F.lit(now) - as_micros(F.col("timestamp"))

    def beyond(age: timedelta):
        return F.col("late_us") > F.lit(age // timedelta(microseconds=1))

    cls = F.when(beyond(retention), "expired").when(beyond(cold_age), "late").otherwise("on_time")
    return df.withColumn("late_us", late_us).withColumn("lateness", cls)
