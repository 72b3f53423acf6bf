"""Search over the hot and cold tables: route, filter, limit per tier, merge, limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.plans.query import LogQuery, Route
from emberlog.schema import COLD_AGE, LOG_COLUMNS

HOT_RANK, COLD_RANK = 0, 1


def _orders(arrival: Sequence[str]) -> dict[str, list[Column]]:
    stamp, seq = F.col("timestamp"), [F.col(c) for c in arrival]
    hot_time = F.when(F.col("tier_rank") == HOT_RANK, stamp)
    return {
        "hot_pick": seq,
        "cold_pick": [stamp, *seq],
        # hot newest first, then cold oldest first
        "merged": [F.col("tier_rank"), hot_time.desc_nulls_last(), stamp, *seq],
        "newest": [stamp.desc(), F.col("id"), *seq],
    }


def pick_order(name: str, arrival: Sequence[str]) -> list[Column]:
    """The order by which a tier's first rows are chosen: 'hot', 'cold', or 'newest' for either."""
    return _orders(arrival)["newest" if name == "newest" else f"{name}_pick"]


def _branches(
    hot: DataFrame, cold: DataFrame, query: LogQuery, route: Route, arrival: Sequence[str], read_hot: bool,
) -> list[tuple[str, DataFrame]]:
    columns = [*LOG_COLUMNS, *(c for c in arrival if c not in LOG_COLUMNS)]
    branches = []
    if read_hot:
        branches.append(("hot", query.match(hot).select(*columns)))
    if route.needs_cold:
        clipped = replace(query, end=route.cutoff) if route.needs_hot else query
        branches.append(("cold", clipped.match(cold).select(*columns)))
    ranks = {"hot": HOT_RANK, "cold": COLD_RANK}
    return [
        (name, df.withColumn("tier", F.lit(name)).withColumn("tier_rank", F.lit(ranks[name])))
        for name, df in branches
    ]


def _union(parts: Sequence[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def _empty(hot: DataFrame, arrival: Sequence[str]) -> DataFrame:
    columns = [*LOG_COLUMNS, *(c for c in arrival if c not in LOG_COLUMNS)]
    return (hot.select(*columns).filter(F.lit(False))
            .withColumn("tier", F.lit("hot")).withColumn("tier_rank", F.lit(HOT_RANK)))


def _prepare(
    hot: DataFrame, cold: DataFrame, query: LogQuery, as_of: datetime | str, cold_age: timedelta,
    arrival: Sequence[str], uncompacted: bool,
) -> tuple[LogQuery, Route, list[tuple[str, DataFrame]]]:
    bounded = query.with_defaults(as_of)
    route = bounded.route(as_of, cold_age)
    read_hot = route.needs_hot or uncompacted
    return bounded, route, _branches(hot, cold, bounded, route, arrival, read_hot)


def matches(
    hot: DataFrame, cold: DataFrame, query: LogQuery, as_of: datetime | str,
    cold_age: timedelta = COLD_AGE, arrival: Sequence[str] = ("ingest_seq",), uncompacted: bool = True,
) -> DataFrame:
    """Every match of both tiers, with its tier; no limit and no order."""
    _, _, branches = _prepare(hot, cold, query, as_of, cold_age, arrival, uncompacted)
    return _union([df for _, df in branches], _empty(hot, arrival))


def search(
    hot: DataFrame, cold: DataFrame, query: LogQuery, as_of: datetime | str,
    cold_age: timedelta = COLD_AGE, arrival: Sequence[str] = ("ingest_seq",), uncompacted: bool = True,
) -> DataFrame:
    """The ordered, limited result rows with their tier.

    `uncompacted` also reads hot for a range that ends before the cutoff, so that aged rows which no
    compaction has moved yet are found. Each tier sorts only its best `limit` rows per partition
    (TakeOrderedAndProject), and the merge handles at most two limits of rows.
    """
    bounded, _, branches = _prepare(hot, cold, query, as_of, cold_age, arrival, uncompacted)
    orders = _orders(arrival)
    if bounded.order == "newest":
        picked = [df.orderBy(*orders["newest"]).limit(bounded.tier_limit) for _, df in branches]
        merged = _union(picked, _empty(hot, arrival)).orderBy(*orders["newest"])
    else:
        picked = [df.orderBy(*orders[f"{name}_pick"]).limit(bounded.tier_limit) for name, df in branches]
        merged = _union(picked, _empty(hot, arrival)).orderBy(*orders["merged"])
    return merged.limit(bounded.limit) if bounded.limit else merged


def with_position(result: DataFrame, order: str = "arrival", arrival: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Add the 1-based position of each row of a search result (at most two limits of rows)."""
    keys = _orders(arrival)["newest" if order == "newest" else "merged"]
    return result.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long"))


def summarize(
    hot: DataFrame, cold: DataFrame, query: LogQuery, as_of: datetime | str,
    cold_age: timedelta = COLD_AGE, arrival: Sequence[str] = ("ingest_seq",), uncompacted: bool = True,
) -> DataFrame:
    """One row: total_count (after the limit), matched_count (before it) and the request's tier.

    Both follow from the matches per tier, so this is one aggregate without any sort.
    """
    found = matches(hot, cold, query, as_of, cold_age, arrival, uncompacted)
    per_tier = found.groupBy("tier").agg(F.count(F.lit(1)).alias("_n"))
    total = F.coalesce(F.sum(F.least(F.col("_n"), F.lit(query.tier_limit))), F.lit(0))
    if query.limit:
        total = F.least(total, F.lit(query.tier_limit))
    return per_tier.agg(
        total.cast("long").alias("total_count"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("matched_count"),
    ).withColumn("tier", F.lit(query.route(as_of, cold_age).tier))


def envelope(
    hot: DataFrame, cold: DataFrame, query: LogQuery, as_of: datetime | str,
    cold_age: timedelta = COLD_AGE, arrival: Sequence[str] = ("ingest_seq",), uncompacted: bool = True,
) -> DataFrame:
    """One row: the limited entries in order, their count and the tier. An empty match is an empty array."""
    result = with_position(
        search(hot, cold, query, as_of, cold_age, arrival, uncompacted), query.order, arrival)
    entry = F.struct("position", *[
        F.map_entries("labels").alias("labels") if c == "labels" else F.col(c) for c in LOG_COLUMNS])
    tier = query.route(as_of, cold_age).tier
    rows = F.sort_array(F.collect_list(entry))
    return result.agg(
        F.transform(rows, lambda e: F.struct(*[
            F.map_from_entries(e["labels"]).alias("labels") if c == "labels" else e[c].alias(c)
            for c in LOG_COLUMNS])).alias("entries"),
        F.count(F.lit(1)).alias("total_count"),
    ).withColumn("tier", F.lit(tier))
