"""Counts and gauges. Every one is a partial aggregate before its shuffle, so hot groups stay cheap."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros
from emberlog.operators.ordered import density_block, order_key, previous, running_sum, seq_block
from emberlog.schema import EVALUATION_STEP, STALE_AFTER
from emberlog.session import settled

STEPS_PER_BLOCK = 10_000


def ingest_counts(logs: DataFrame) -> DataFrame:
    """Entries by source and level."""
    return logs.groupBy("source", "level").agg(F.count(F.lit(1)).alias("entries"))


def error_counts(rejected: DataFrame) -> DataFrame:
    """Rejected records by error type."""
    return rejected.groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))


def query_counts(query_log: DataFrame) -> DataFrame:
    """Queries by tier and status."""
    return query_log.groupBy("tier", "status").agg(F.count(F.lit(1)).alias("queries"))


def tier_counts(tiered: DataFrame) -> DataFrame:
    """Stored entries by tier."""
    return tiered.groupBy("tier").agg(F.count(F.lit(1)).alias("entries"))


def storage_by_tier(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Bytes and objects below a folder, from its listing; no file is opened."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
             .load(path).select("length"))
    return files.agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.count(F.lit(1)).alias("objects"),
    ).select(F.lit(tier).alias("tier"), "bytes", "objects")


def consumer_lag(samples: DataFrame) -> DataFrame:
    """Lag of the latest sample per consumer group and partition: max(high water mark - offset - 1, 0)."""
    ahead = F.col("high_water_mark") - F.col("offset") - F.lit(1)
    return samples.groupBy("consumer_group", "partition").agg(
        F.greatest(F.max_by(ahead, order_key(samples, ["ts", "offset"])), F.lit(0)).cast("long").alias("lag"))


def lag_by_group(lag: DataFrame) -> DataFrame:
    return lag.groupBy("consumer_group").agg(F.sum("lag").alias("lag"))


def lag_series(samples: DataFrame, step: timedelta = EVALUATION_STEP, stale: timedelta = STALE_AFTER) -> DataFrame:
    """(consumer_group, ts, lag): the group's summed lag at every evaluation step at which it has a partition.

    At a step each partition counts with its last sample up to then, if that is younger than `stale`. A sample becomes two changes of
    the sum: it adds to it at its time, and takes the same away at the next sample's or when it goes stale. Changes are added up
    per step before any running sum, and the sums run in blocks, so a busy partition or group is many tasks.
    """
    us, width, age = as_micros(F.col("ts")), step // timedelta(microseconds=1), stale // timedelta(microseconds=1)
    lags = samples.select(
        "consumer_group", "partition", "ts", us.alias("_us"), (-us).alias("_back_us"), (-F.col("offset")).alias("_back_offset"),
        F.greatest(F.col("high_water_mark") - F.col("offset") - 1, F.lit(0)).cast("long").alias("lag"))
    keys = ["consumer_group", "partition"]

    def step_of(at: Column) -> Column:
        return F.ceil(at / F.lit(width)).cast("long")

    # The next sample is the preceding one in descending order.
    followed = previous(lags, keys, ["_back_us", "_back_offset"], ["_us"], -density_block(lags, keys, "ts"), "next_")
    until = F.least(F.coalesce("next__us", F.col("_us") + age), F.col("_us") + age)
    ends = F.array(F.struct(F.col("_us").alias("_at"), F.col("lag").alias("_lag"), F.lit(1).alias("_live")),
                   F.struct(until.alias("_at"), (-F.col("lag")).alias("_lag"), F.lit(-1).alias("_live")))
    changes = (followed.select("consumer_group", F.inline(ends))
               .groupBy("consumer_group", step_of(F.col("_at")).alias("_step")).agg(F.sum("_lag").alias("_lag"), F.sum("_live").alias("_live")))
    # One row per group and step from here on; the steps below read it, not the samples.
    changes = settled(changes, "lag-changes")
    block = seq_block("_step", STEPS_PER_BLOCK)
    lagging = settled(running_sum(changes, ["consumer_group"], "_step", "_lag", "lag", block), "lag-sums")
    sums = running_sum(lagging, ["consumer_group"], "_step", "_live", "live", block)
    back = settled(sums.withColumn("_back", -F.col("_step")), "lag-steps")
    until = previous(back, ["consumer_group"], ["_back"], ["_step"], seq_block("_back", STEPS_PER_BLOCK))
    return (until.filter("live > 0").select("consumer_group", "lag", F.explode(F.sequence("_step", F.col("prev__step") - 1)).alias("_step"))
            .select("consumer_group", F.timestamp_micros(F.col("_step") * width).alias("ts"), "lag"))


def active_partitions(samples: DataFrame) -> DataFrame:
    """Distinct partitions consumed per group."""
    distinct = samples.groupBy("consumer_group", "partition").agg(F.lit(1).alias("seen"))
    return distinct.groupBy("consumer_group").agg(F.count("seen").alias("active_partitions"))


def acknowledged(entries: DataFrame, batch: str) -> DataFrame:
    """Accepted entries per batch."""
    return entries.groupBy(batch).agg(F.count(F.lit(1)).alias("ingested"))
