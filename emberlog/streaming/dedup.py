"""Removal of redelivered copies. Off by default: delivery is at least once and ids are optional."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.ordered import order_key


def drop_redelivered_stream(logs: DataFrame, delay: str = "24 hours", salts: int = 16) -> DataFrame:
    """Keep the first copy of each non-empty id of the last `delay`; rows without an id all pass.

    Ids are remembered by the time of their batch, not by the entry's own timestamp: an entry that is late by its
    timestamp is never behind the watermark, so no id is lost. A copy that comes more than `delay` after the first
    one passes.

    The first step drops copies per (id, salt), where the salt comes from the record's position, so
    an id with very many copies is spread over `salts` tasks and at most `salts` rows of it reach the
    second step. Rows need partition and offset columns for that; without them there is one step.
    """
    marked = logs.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    named = marked.filter(F.coalesce(F.col("id"), F.lit("")) != "")
    anonymous = marked.filter(F.coalesce(F.col("id"), F.lit("")) == "")
    if {"partition", "offset"} <= set(logs.columns):
        salted = named.withColumn("_salt", F.pmod(F.xxhash64("partition", "offset"), F.lit(salts)))
        named = salted.dropDuplicatesWithinWatermark(["id", "_salt"]).drop("_salt")
    return named.dropDuplicatesWithinWatermark(["id"]).unionByName(anonymous).drop("_arrived")


def drop_redelivered(logs: DataFrame, order: tuple[str, ...] = ("ingest_seq",)) -> DataFrame:
    """Batch form: the first copy in arrival order of each non-empty id, and all rows without one.

    The order is unique. The first place of each id is a hash aggregate over fixed-width columns, combined before the
    shuffle; only ids with several copies go through it again to find the other copies, which are then taken out.
    """
    has_id = F.coalesce(F.col("id"), F.lit("")) != ""
    named = logs.filter(has_id)
    place = order_key(logs, order)
    first = named.groupBy(F.col("id").alias("_id")).agg(F.min(place).alias("_place"), F.count(F.lit(1)).alias("_copies"))
    several = first.filter("_copies > 1")
    return logs.join(several, (logs["id"] == F.col("_id")) & (place != F.col("_place")), "left_anti")
