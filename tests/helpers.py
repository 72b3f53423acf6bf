"""Small builders of log rows."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

from emberlog.schema import LOG_FIELDS, LOG_SCHEMA

NOW = datetime(2024, 3, 10, 12, 0, 0, tzinfo=timezone.utc)
SEQ_SCHEMA = T.StructType(LOG_FIELDS + [T.StructField("ingest_seq", T.LongType())])


def batch(n, source, at, level="INFO", labels=None):
    """n rows one millisecond apart."""
    return [
        (f"{source}-{i}", at + timedelta(milliseconds=i), source, level, f"message {i} from {source}", labels, None, None)
        for i in range(n)
    ]


def logs(spark, *batches):
    rows = [row for b in batches for row in b]
    return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], SEQ_SCHEMA)


def plain(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
