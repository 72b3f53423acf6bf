"""Delivery check on streams: what is sent and not stored in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.operators.reconcile import has_id


def delivery(sent: DataFrame, stored: DataFrame, within: str, key: str = "id", sent_ts: str = "sent_at", stored_ts: str = "stored_at",
             delay: str = "10 minutes") -> DataFrame:
    """Rows of `sent` with the time of a stored copy, or null for one that is lost: no copy from its time to `within` after it.

    An outer join of two streams, in append mode. A row is lost once both watermarks have passed its time and `within`, so
    nothing that comes later can take it back; a row with several copies comes out once per copy. Rows without an id
    take no part. State holds the rows of `within` and the delay.
    """
    left = sent.withWatermark(sent_ts, delay).filter(has_id(key))
    right = (stored.select(F.col(key).alias("_stored"), stored_ts).withWatermark(stored_ts, delay).filter(has_id("_stored")))
    in_time = (F.col(key) == F.col("_stored")) & (F.col(stored_ts) >= F.col(sent_ts)) & (F.col(stored_ts) <= F.col(sent_ts) + F.expr(f"INTERVAL {within}"))
    return left.join(right, in_time, "leftOuter").select(*sent.columns, stored_ts)
