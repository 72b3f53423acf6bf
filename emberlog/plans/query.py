"""The search request: an optional-predicate filter with a range, a limit and an order."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.labels import labels_match, message_contains
from emberlog.functions.timefmt import ZERO_TIME, column_type, time_literal, utc
from emberlog.schema import COLD_AGE, DEFAULT_LIMIT, DEFAULT_RANGE


@dataclass(frozen=True)
class Route:
    """Which tiers a request needs, and the boundary between them."""

    needs_hot: bool
    needs_cold: bool
    cutoff: datetime

    @property
    def tier(self) -> str:
        if self.needs_hot and self.needs_cold:
            return "tiered"
        return "cold" if self.needs_cold else "hot"


@dataclass(frozen=True)
class LogQuery:
    """All present predicates must hold; an empty value means "no predicate".

    `limit` 0 means 1000 rows per tier and no cut of the merged result. `order` is 'arrival' (the
    first matches of each tier: hot in arrival order shown newest first, then cold by time) or
    'newest' (the newest matches over both tiers).
    """

    start: datetime | str | None = None
    end: datetime | str | None = None
    source: str = ""
    level: str = ""
    text: str = ""
    labels: Mapping[str, str] = field(default_factory=dict)
    limit: int = 0
    order: str = "arrival"

    def __post_init__(self) -> None:
        if self.limit < 0:
            raise ValueError("limit must not be negative")
        if self.order not in ("arrival", "newest"):
            raise ValueError(f"unknown order {self.order!r}")

    @classmethod
    def from_request(cls, body: Mapping) -> LogQuery:
        """From a decoded request body: start_time, end_time, source, level, query, labels, limit; all optional."""
        def instant(name: str) -> datetime | None:
            text = body.get(name)
            return None if not text or utc(text) == utc(ZERO_TIME) else utc(text)

        return cls(
            start=instant("start_time"), end=instant("end_time"), source=body.get("source") or "",
            level=body.get("level") or "", text=body.get("query") or "", labels=dict(body.get("labels") or {}),
            limit=body.get("limit") or 0)

    def with_defaults(self, as_of: datetime | str) -> LogQuery:
        """Missing ends become [as_of - 1 h, as_of], each on its own.

        Only `end` given and older than an hour leaves start after end: an empty range.
        """
        now = utc(as_of)
        return replace(
            self,
            start=now - DEFAULT_RANGE if self.start is None else utc(self.start),
            end=now if self.end is None else utc(self.end),
        )

    def route(self, as_of: datetime | str, cold_age: timedelta = COLD_AGE) -> Route:
        bounded = self.with_defaults(as_of)
        cutoff = utc(as_of) - cold_age
        return Route(needs_hot=bounded.end > cutoff, needs_cold=bounded.start < cutoff, cutoff=cutoff)

    @property
    def tier_limit(self) -> int:
        return self.limit or DEFAULT_LIMIT

    def predicate(self, df: DataFrame) -> Column:
        """The filter over `df`. Time literals take the type of its timestamp column."""
        dtype = column_type(df, "timestamp")
        terms: list[Column] = []
        if self.start is not None:
            terms.append(F.col("timestamp") >= time_literal(self.start, dtype))
        if self.end is not None:
            terms.append(F.col("timestamp") <= time_literal(self.end, dtype))
        if "dt" in df.columns:
            # Spark does not derive bounds on the partition column from bounds on the timestamp.
            if self.start is not None:
                terms.append(F.col("dt") >= F.lit(utc(self.start).date()))
            if self.end is not None:
                terms.append(F.col("dt") <= F.lit(utc(self.end).date()))
        if self.level:
            terms.append(F.col("level") == F.lit(self.level))
        if self.source:
            terms.append(F.col("source") == F.lit(self.source))
        if self.text:
            terms.append(message_contains(F.col("message"), self.text))
        if self.labels:
            terms.append(labels_match(F.col("labels"), self.labels))
        condition = F.lit(True)
        for term in terms:
            condition = condition & term
        return condition

    def match(self, df: DataFrame) -> DataFrame:
        """Every matching row, without a limit."""
        return df.filter(self.predicate(df))
