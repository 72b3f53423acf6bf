"""A clustering key of several columns: the bits of their ranks, interleaved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the cut points are taken from: those with the least hashes, which is a uniform sample.
SAMPLE_ROWS = 4096
#: Bits of a column's rank; a column has up to 2**RANK_BITS - 1 cut points.
RANK_BITS = 5


def cut_points(df: DataFrame, columns: Sequence[str], salt: Sequence[str], bits: int = RANK_BITS) -> dict[str, list]:
    """Values that cut each column into about equally many rows, from a bounded sample in one pass.

    `salt` names columns that tell rows apart. A value that many rows share is one cut point, so it has a rank of its own.
    """
    sample = df.select(*columns).orderBy(F.xxhash64(*salt)).limit(SAMPLE_ROWS).collect()
    points = {}
    for i, column in enumerate(columns):
        values = sorted(row[i] for row in sample if row[i] is not None)
        steps = 1 << bits
        points[column] = sorted({values[len(values) * k // steps] for k in range(1, steps)} - {values[0]}) if values else []
    return points


def rank(column: str, points: Sequence) -> Column:
    """How many cut points a value has reached; null ranks lowest."""
    reached = F.lit(0)
    for point in points:
        reached = reached + F.coalesce((F.col(column) >= F.lit(point)).cast("int"), F.lit(0))
    return reached


def interleaved(points: dict[str, list], bits: int = RANK_BITS) -> Column:
    """The clustering key: rows that are close in it are close in every column, the first one a little closer."""
    key = F.lit(0)
    names = list(points)
    for place, name in enumerate(reversed(names)):
        ranked = rank(name, points[name])
        for bit in range(bits):
            one = F.shiftright(ranked, bit).bitwiseAND(F.lit(1))
            key = key.bitwiseOR(F.shiftleft(one.cast("long"), bit * len(names) + place))
    return key
