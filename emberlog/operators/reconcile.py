"""Delivery reconciliation: which sent ids arrived, which were lost, which arrived more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def has_id(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("")) != ""


def reconcile(sent: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """One row per distinct sent id: copies stored, and `delivered`, `lost` or `redelivered`.

    Ids are optional: rows whose id is null or empty cannot be matched and are left out here, in `lost` and in
    `recovered`. Copies are counted before the join, so an id with very many copies is one row on each side.
    """
    ids = sent.filter(has_id(key)).groupBy(key).agg(F.lit(1).alias("_sent"))
    copies = stored.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
    joined = ids.join(copies, key, "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    status = (F.when(F.col("copies") == 0, "lost").when(F.col("copies") == 1, "delivered")
              .otherwise("redelivered"))
    return joined.select(key, "copies", status.alias("status"))


def lost(sent: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Sent rows with an id and without a stored copy."""
    return sent.filter(has_id(key)).join(stored.select(key).distinct(), key, "left_anti")


def recovered(sent: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """Sent rows with an id and a stored copy."""
    return sent.filter(has_id(key)).join(stored.select(key).distinct(), key, "left_semi")


def totals(reconciled: DataFrame) -> DataFrame:
    """One row: ids sent, recovered, lost and redelivered, and extra copies."""
    return reconciled.agg(
        F.count(F.lit(1)).alias("sent"),
        F.count_if(F.col("status") != "lost").alias("recovered"),
        F.count_if(F.col("status") == "lost").alias("lost"),
        F.count_if(F.col("status") == "redelivered").alias("redelivered"),
        F.coalesce(F.sum(F.greatest(F.col("copies") - 1, F.lit(0))), F.lit(0)).alias("extra_copies"))
