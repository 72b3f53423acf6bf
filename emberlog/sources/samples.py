"""Metric samples (ts, name, labels, le, value)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.labels import label
from emberlog.functions.timefmt import time_literal
from emberlog.schema import METRIC_SCHEMA


def read_samples(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(METRIC_SCHEMA).parquet(path)


def series(samples: DataFrame, name: str, labels: tuple[str, ...] = (), start: datetime | str | None = None,
           end: datetime | str | None = None) -> DataFrame:
    """Samples of one metric with the wanted labels as columns."""
    rows = samples.filter(F.col("name") == name)
    if start is not None:
        rows = rows.filter(F.col("ts") >= time_literal(start, T.TimestampType()))
    if end is not None:
        rows = rows.filter(F.col("ts") <= time_literal(end, T.TimestampType()))
    return rows.select("ts", *[label(F.col("labels"), k).alias(k) for k in labels], "le", "value")
