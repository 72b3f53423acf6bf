"""Ordered computations per key that never put a whole key into one task.

A key's rows are cut into blocks of bounded size. Each block is windowed on its own, each block also
yields one summary row, a window over the summary rows gives what precedes a block, and a join on
(key, block) adds it. The join reuses the partitioning of the block window. Keys must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_block"
SEQ_BLOCK = 1_000_000
TIME_BLOCK_SECONDS = 300
ROWS_PER_BLOCK = 100_000
#: How many times the rows aimed at a block may hold.
SLACK = 4


def seq_block(seq: str, size: int = SEQ_BLOCK) -> Column:
    """Block number of a unique integer sequence: at most `size` rows per key and block."""
    return F.floor(F.col(seq) / F.lit(size)).cast("long")


def time_block(ts: str, seconds: int = TIME_BLOCK_SECONDS) -> Column:
    """Block number by time, for regularly sampled series (a bounded number of samples per span)."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def density_block(df: DataFrame, keys: Sequence[str], ts: str, rows: int = ROWS_PER_BLOCK) -> Column:
    """Block number by time, so that a block of a key holds about `rows` rows at most.

    The width starts with what the densest of the keys that need cutting has on average (keys of up to `rows` rows need none,
    however sparse they are) and shrinks while some slice still holds more than SLACK times as many, as in a burst inside a
    long span. Only rows that share one microsecond are never parted. Each step is one small aggregate over the table, so derived
    tables should be settled first. A stream, which cannot be looked at first, gets blocks of fixed width.
    """
    if df.isStreaming:
        return time_block(ts)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max(us) - F.min(us) + 1).alias("span"))
    width = per_key.filter(F.col("n") > rows).agg(F.min(F.col("span") / F.col("n"))).first()[0]
    if width is None:
        return F.lit(0).cast("long")
    width = max(1, int(width * rows))
    while width > 1:
        slices = df.groupBy(*keys, F.floor(us / F.lit(width)).alias(BLOCK)).agg(F.count(F.lit(1)).alias("n"))
        most = slices.agg(F.max("n")).first()[0]
        if most <= SLACK * rows:
            break
        width = max(1, width * rows // most)
    return F.floor(us / F.lit(width)).cast("long")


def order_key(df: DataFrame, order: Sequence[str]) -> Column:
    """One comparable column for an order: a time and an integer are packed into a decimal, since an
    aggregate over fixed-width columns hashes, while one over structs sorts its whole input."""
    types = [df.schema[c].dataType for c in order]
    if len(order) == 1:
        return F.col(order[0])
    times = (T.TimestampType, T.TimestampNTZType)
    if len(order) == 2 and isinstance(types[0], times) and isinstance(types[1], T.IntegralType):
        us = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("decimal(18,0)")
        # Wider than the range of a bigint, so the integer never reaches the next microsecond.
        wide = us * F.lit("20000000000000000000").cast("decimal(20,0)")
        return (wide + F.col(order[1]).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.struct(*order)


def _attach(blocked: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocked.join(carried, [*keys, BLOCK], "left")


def running_sum(df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str, block: Column) -> DataFrame:
    """Sum of `value` over all rows of the key up to and including this one."""
    data = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = data.groupBy(*keys, BLOCK).agg(F.sum(value).alias("_total"))
    carried = totals.select(*keys, BLOCK, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    local = data.withColumn("_local", F.sum(value).over(inside))
    return (_attach(local, carried, keys)
            .withColumn(out, F.col("_local") + F.col("_carry"))
            .drop("_local", "_carry", BLOCK))


def running_max(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, block: Column) -> DataFrame:
    """Maximum of `value` over all rows of the key up to and including this one; nulls are skipped."""
    data = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    tops = data.groupBy(*keys, BLOCK).agg(F.max(value).alias("_top"))
    carried = tops.select(*keys, BLOCK, F.max("_top").over(before).alias("_carry"))
    local = data.withColumn("_local", F.max(value).over(inside))
    return (_attach(local, carried, keys)
            .withColumn(out, F.greatest("_local", "_carry"))
            .drop("_local", "_carry", BLOCK))


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], block: Column,
             prefix: str = "prev_") -> DataFrame:
    """The given columns of the key's preceding row, as `prev_<column>`."""
    data = df.withColumn(BLOCK, block)
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order)
    by_block = Window.partitionBy(*keys).orderBy(BLOCK)
    key = order_key(df, order)
    ends = [F.max_by(c, key).alias(f"_last_{c}") for c in columns]
    last = data.groupBy(*keys, BLOCK).agg(*ends)
    carried = last.select(
        *keys, BLOCK, *[F.lag(f"_last_{c}").over(by_block).alias(f"_carry_{c}") for c in columns])
    local = data.withColumn("_first", F.row_number().over(inside) == 1)
    for c in columns:
        local = local.withColumn(f"_lag_{c}", F.lag(c).over(inside))
    attached = _attach(local, carried, keys)
    return attached.select(*df.columns, *[
        F.when(F.col("_first"), F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"{prefix}{c}")
        for c in columns])


def global_rank(df: DataFrame, seq: str, out: str, size: int = SEQ_BLOCK) -> DataFrame:
    """1-based rank of a unique integer sequence over the whole table, without a global window over rows."""
    data = df.withColumn(BLOCK, seq_block(seq, size))
    before = Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counts = data.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("_n"))
    # One row per block of up to `size` rows reaches this window.
    carried = counts.select(BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carry"))
    local = data.withColumn("_local", F.row_number().over(Window.partitionBy(BLOCK).orderBy(seq)))
    return (local.join(carried, BLOCK)
            .withColumn(out, F.col("_local") + F.col("_carry"))
            .drop("_local", "_carry", BLOCK))
