"""Limited reads that stop early: parts of a table are read in order of the best key they can hold."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from emberlog.session import settled


@dataclass(frozen=True)
class Part:
    """Something that can be read on its own: `best` is a bound of the key of every row in it."""

    name: str
    best: tuple
    rows: int


@dataclass(frozen=True)
class Found:
    """The first rows, and how many of the parts were read for them."""

    rows: DataFrame | None
    parts_read: int
    parts: int


def first_rows(parts: Sequence[Part], read: Callable[[list[Part]], DataFrame], order: Sequence[Column], limit: int,
               worst: Callable[[DataFrame], tuple | None], newest: bool = False) -> Found:
    """The first `limit` rows of `order` among all parts, reading parts until no further one can hold any of them.

    `read` gives the matching rows of some parts, `worst` the key of the last row of a full result (null-free, comparable with
    `best`). Parts come in order of `best`, ascending, or descending with `newest`. The first slice has at least
    `limit` rows; each further one has twice as many parts as the one before, so a selective filter ends after
    log2(parts) rounds and at most half of what is read was not needed. What is kept between rounds is `limit` rows.
    """
    found: DataFrame | None = None
    at, width = 0, 1
    while at < len(parts):
        end = at + width
        if at == 0:
            while end < len(parts) and sum(p.rows for p in parts[:end]) < limit:
                end += 1
        end = min(end, len(parts))
        rows = read(list(parts[at:end]))
        both = rows if found is None else found.unionByName(rows)
        found = settled(both.orderBy(*order).limit(limit), "first")
        width, at = 2 * (end - at), end
        if at < len(parts) and found.count() >= limit:
            last, following = worst(found), parts[at].best
            # A part whose best key equals the last one may still win by the rest of the order.
            if last is not None and (following < last if newest else following > last):
                break
    return Found(found, at, len(parts))
