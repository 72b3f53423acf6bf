"""Predicates over the flat `labels` map and the message text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(labels: Column, key: str) -> Column:
    """Value under `key`, with '' for a missing key or a missing map."""
    return F.coalesce(labels[key], F.lit(""))


def labels_match(labels: Column, wanted: Mapping[str, str]) -> Column:
    """All wanted pairs are present; a wanted '' also matches an absent key."""
    return reduce(
        lambda acc, pair: acc & (label(labels, pair[0]) == F.lit(pair[1])),
        sorted(wanted.items()),
        F.lit(True),
    )


def message_contains(message: Column, text: str) -> Column:
    """Case-sensitive substring test; `%` and `_` are ordinary characters."""
    return F.contains(message, F.lit(text))
