"""Figures from merged sketches, held against the exact ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.rates import slot_start
from emberlog.operators.sketches import (
    distinct_of, distinct_sketches, merge_distinct, merge_quantiles, over_range, over_windows, quantile_of, quantile_sketches,
)
from emberlog.session import settled
from emberlog.workload.fixtures import events
from emberlog.workload.metrics import HOUR, HOUR_US, LAG_CTE, LATENCIES_CTE, lag_samples, latencies
from emberlog.workload.registry import query

#: What a merged sketch may be off by: in normalised rank, and in share of a distinct count.
RANK_ERROR, DISTINCT_ERROR = 0.02, 0.08
WINDOWS = "CROSS JOIN (SELECT unnest(range(6)) AS k) AS o"


def _in_windows(rows: DataFrame) -> DataFrame:
    """Every row once per window of six hours, hourly, that covers it."""
    slot = slot_start(F.col("ts"), HOUR)
    return rows.withColumn("window_start", F.explode(F.sequence(slot - 5 * HOUR_US, slot, F.lit(HOUR_US).cast("long"))))


def _rank_holds(rows: DataFrame, sketched: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by.., observations, within): is the estimate's true rank within the error of q?"""
    estimates = settled(sketched.select(*by, quantile_of(F.col("sketch"), q).alias("estimate"),
                                        F.kll_sketch_get_n_double("sketch").alias("sketched")), "estimates")
    ranks = rows.join(estimates, by).groupBy(*by, "sketched").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("seconds") < F.col("estimate")).alias("below"),
        F.count_if(F.col("seconds") <= F.col("estimate")).alias("upto"))
    low, high = F.col("below") / F.col("observations"), F.col("upto") / F.col("observations")
    # Sketches of few rows are exact, with ranks that step by one row.
    slack = F.lit(RANK_ERROR) + F.lit(1) / F.col("observations")
    return ranks.select(*by, "observations", ((F.col("sketched") == F.col("observations"))
                                              & (low <= F.lit(q) + slack) & (high >= F.lit(q) - slack)).alias("within"))


@query(f"""WITH {LATENCIES_CTE} SELECT source, count(*) AS observations, true AS within FROM latencies GROUP BY 1""")
def sketch_p95(spark: SparkSession, sf: str) -> DataFrame:
    """p95 per source over the whole time, merged from hourly sketches; its true rank must be within the error."""
    rows = latencies(spark, sf)
    hourly = quantile_sketches(rows, "ts", "seconds", ["source"], HOUR)
    return _rank_holds(rows, over_range(hourly, ["source"], merge_quantiles), ["source"], 0.95)


@query(f"""WITH {LATENCIES_CTE} SELECT tier, epoch_us(ts) // {HOUR_US} * {HOUR_US} - o.k * {HOUR_US} AS window_start,
    count(*) AS observations, true AS within FROM latencies {WINDOWS} GROUP BY 1, 2""")
def sketch_p95_6h(spark: SparkSession, sf: str) -> DataFrame:
    """p95 per tier over six hours, every hour, each window from two merged sketches."""
    rows = latencies(spark, sf)
    merged = over_windows(quantile_sketches(rows, "ts", "seconds", ["tier"], HOUR), ["tier"], merge_quantiles, 6 * HOUR, HOUR)
    return _rank_holds(_in_windows(rows), merged, ["tier", "window_start"], 0.95)


@query(f"""WITH {LAG_CTE} SELECT consumer_group, epoch_us(ts) // {HOUR_US} * {HOUR_US} - o.k * {HOUR_US} AS window_start,
    count(DISTINCT partition) AS active_partitions FROM lag_samples {WINDOWS} GROUP BY 1, 2""")
def sketch_active_partitions_6h(spark: SparkSession, sf: str) -> DataFrame:
    """Partitions a group consumed in six hours, every hour; counts as small as these are exact."""
    hourly = distinct_sketches(lag_samples(spark, sf), "ts", "partition", ["consumer_group"], HOUR)
    merged = over_windows(hourly, ["consumer_group"], merge_distinct, 6 * HOUR, HOUR)
    return merged.select("consumer_group", "window_start", distinct_of(F.col("sketch")).alias("active_partitions"))


@query("""SELECT event_type, count(DISTINCT event_id) AS entries, count(DISTINCT user_id) AS users, true AS within
    FROM events GROUP BY 1""")
def sketch_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct entries and users per event type, merged from hourly sketches, beside the exact counts."""
    rows = events(spark, sf)
    exact = rows.groupBy("event_type").agg(F.count_distinct("event_id").alias("entries"), F.count_distinct("user_id").alias("users"))
    for name, column in (("entries", "event_id"), ("users", "user_id")):
        hourly = distinct_sketches(rows, "ts", column, ["event_type"], HOUR)
        merged = over_range(hourly, ["event_type"], merge_distinct).select("event_type", distinct_of(F.col("sketch")).alias(f"_{name}"))
        exact = exact.join(merged, "event_type")
    near = [F.abs(F.col(f"_{n}") - F.col(n)) <= F.col(n) * DISTINCT_ERROR for n in ("entries", "users")]
    return exact.select("event_type", "entries", "users", (near[0] & near[1]).alias("within"))
