"""Cumulative latency histograms, their quantiles, and exact quantiles by floor rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import settled

INF = float("inf")


def exponential_bounds(start: float, factor: float, count: int) -> list[float]:
    bounds = [start]
    while len(bounds) < count:
        bounds.append(bounds[-1] * factor)
    return bounds


# Fixed bucket bounds in seconds.
INGEST_BOUNDS = exponential_bounds(0.001, 2, 15)
PRODUCE_BOUNDS = exponential_bounds(0.0005, 2, 12)
QUERY_BOUNDS = exponential_bounds(0.005, 2, 14)
COMPACTION_BOUNDS = exponential_bounds(0.1, 2, 10)


def _buckets(value: Column, bounds: Sequence[float]) -> list[Column]:
    finite = [F.count_if(value <= F.lit(b)) for b in bounds]
    return [*finite, F.count(value)]


def latency_histogram(df: DataFrame, value: str, bounds: Sequence[float], by: Sequence[str | Column] = ()) -> DataFrame:
    """Rows (by.., le, count, observations, total) with one cumulative count per bound and +Inf.

    One pass and one partial aggregate: all bounds are counted side by side, then laid out as rows.
    """
    edges = [*bounds, INF]
    names = [f"_b{i}" for i in range(len(edges))]
    counted = df.groupBy(*by).agg(
        *[c.alias(n) for c, n in zip(_buckets(F.col(value), bounds), names)],
        F.sum(value).alias("total"))
    kept = [c for c in counted.columns if c not in (*names, "total")]
    rows = F.array(*[
        F.struct(F.lit(edge).alias("le"), F.col(name).alias("count")) for edge, name in zip(edges, names)])
    return counted.select(
        *kept, F.inline(rows), F.col(names[-1]).alias("observations"),
        F.coalesce("total", F.lit(0.0)).alias("total"))


def histogram_quantile(buckets: DataFrame, q: float, by: Sequence[str] = (), count: str = "count") -> DataFrame:
    """Quantile of a cumulative histogram by linear interpolation inside the bucket that holds the rank.

    In the +Inf bucket the highest finite bound is returned. A group without observations yields null.
    Each group is one row per bound, so the window is small.
    """
    ordered = Window.partitionBy(*by).orderBy("le") if by else Window.orderBy("le")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.max(F.when(F.col("le") == F.lit(INF), F.col(count))).over(whole)
    marked = buckets.select(
        *by, "le", F.col(count).cast("double").alias("_c"),
        F.coalesce(F.lag("le").over(ordered), F.lit(0.0)).alias("_lo"),
        F.coalesce(F.lag(F.col(count).cast("double")).over(ordered), F.lit(0.0)).alias("_below"),
        (F.lit(q) * total).alias("_rank"), total.alias("_total"))
    inside = F.col("_lo") + (F.col("le") - F.col("_lo")) * (
        F.col("_rank") - F.col("_below")) / F.nullif(F.col("_c") - F.col("_below"), F.lit(0.0))
    estimate = F.when(F.col("le") == F.lit(INF), F.col("_lo")).otherwise(inside)
    reached = (F.col("_c") >= F.col("_rank")) & (F.col("_total") > 0)
    return marked.groupBy(*by).agg(
        F.min_by(F.when(reached, estimate), F.when(reached, F.col("le"))).alias("quantile"))


def quantile_of_counts(counts: Sequence[Column], edges: Sequence[float], q: float) -> Column:
    """`histogram_quantile` for one histogram held in columns: no rows per bucket, no shuffle.

    `counts` are cumulative and `edges` ends with +Inf.
    """
    total = counts[-1].cast("double")
    rank = F.lit(q) * total
    estimate = None
    for i, (edge, count) in enumerate(zip(edges, counts)):
        low = F.lit(edges[i - 1] if i else 0.0)
        below = counts[i - 1].cast("double") if i else F.lit(0.0)
        if edge == INF:
            value = low
        else:
            value = low + (F.lit(edge) - low) * (rank - below) / F.nullif(count.cast("double") - below, F.lit(0.0))
        reached = (count.cast("double") >= rank) & (total > 0)
        estimate = F.when(reached, value) if estimate is None else estimate.when(reached, value)
    return estimate


def _locate(counts: DataFrame, by: Sequence[str], order: str, rank: Column, left: str) -> DataFrame:
    """The row of each group in which the wanted rank falls; `left` is the rank within that row."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_rank", rank)
    inside = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
    return marked.filter(inside).withColumn(
        left, F.col("_rank") - (F.col("_upto") - F.col("_n"))).drop("_upto", "_rank", "_n")


def _join_groups(rows: DataFrame, chosen: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns that may be null."""
    renamed = chosen.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in chosen.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on]
    return rows.join(renamed, same).drop(*[f"_on_{c}" for c in on])


def floor_rank_quantile(df: DataFrame, value: str, by: Sequence[str], q: float = 0.95, slots: int = 4096) -> DataFrame:
    """Exact quantile: the value at 1-based position max(floor(n * q), 1) of each sorted group.

    No group is ever sorted whole. Values are counted into coarse slots (by magnitude), then, inside
    the one slot that holds the rank, into `slots` even slices, and only the distinct values of one
    slice are ranked. Each of the three passes reads two columns and is a partial aggregate before its
    shuffle; the choices in between (one row per group) are settled. Nulls are ignored.
    """
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # Monotone in the value: 32 slots per power of two, mirrored below zero.
    size = F.floor(F.log2(F.abs("_v")) * F.lit(32)) + F.lit(40_000)
    beyond = F.lit(1 << 20)
    coarse = (F.when(F.isnan("_v") | (F.col("_v") == INF), beyond).when(F.col("_v") == -INF, -beyond)
              .when(F.col("_v") > 0, size).when(F.col("_v") < 0, -size)
              .otherwise(F.lit(0))).cast("long")
    slotted = data.withColumn("_slot", coarse)
    counts = slotted.groupBy(*by, "_slot").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    rank = F.greatest(F.floor(F.sum("_n").over(Window.partitionBy(*by)) * F.lit(q)), F.lit(1))
    slot = settled(_locate(counts, by, "_slot", rank, "_left"), "quantile-slot")

    span = F.col("_hi") - F.col("_lo")
    # One value, or infinities and NaN: a single slice.
    slice_ = F.when((span > 0) & (span < INF), F.floor((F.col("_v") - F.col("_lo")) / span * F.lit(slots))
                    ).otherwise(F.lit(0)).cast("long")
    sliced = _join_groups(slotted, slot, [*by, "_slot"]).withColumn("_slice", slice_)
    slices = sliced.groupBy(*by, "_slot", "_lo", "_hi", "_left", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    wanted = settled(
        _locate(slices, by, "_slice", F.col("_left"), "_within").withColumnRenamed("_slice", "_wanted")
        .drop("_left"), "quantile-slice")

    last = _join_groups(slotted, wanted, [*by, "_slot"]).withColumn("_slice", slice_).filter("_slice = _wanted")
    # Equal values of a hot group collapse before the shuffle.
    distinct = last.groupBy(*by, "_within", "_v").agg(F.count(F.lit(1)).alias("_n"))
    return _locate(distinct, by, "_v", F.col("_within"), "_left").select(*by, F.col("_v").alias("quantile"))


def approximate_quantile(df: DataFrame, value: str, by: Sequence[str], q: float = 0.95, accuracy: int = 10_000) -> DataFrame:
    """One-pass sketch quantile with relative rank error 1 / accuracy; not exact."""
    return df.groupBy(*by).agg(F.percentile_approx(value, q, accuracy).alias("quantile"))
