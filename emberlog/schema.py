"""Row schemas and the fixed defaults every job shares."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import types as T

LOG_FIELDS = [
    T.StructField("id", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("trace_id", T.StringType()),
    T.StructField("span_id", T.StringType()),
]
LOG_SCHEMA = T.StructType(LOG_FIELDS)
LOG_COLUMNS = [f.name for f in LOG_FIELDS]

# One record of a stream of encoded entries. `timestamp` is the time the record was appended.
RECORD_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

# What the hot table stores: the entry, its position in the stream it came from, and for a
# rejected record the raw text and the reason.
HOT_SCHEMA = T.StructType(LOG_FIELDS + [
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("raw", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("run", T.IntegerType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("status", T.StringType()),
])

# What the cold table stores: the entry, its arrival position, and the partition columns.
COLD_SCHEMA = T.StructType(LOG_FIELDS + [
    T.StructField("run", T.IntegerType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("compaction", T.StringType()),
    T.StructField("dt", T.DateType()),
])

# Arrival order of stored rows.
ARRIVAL = ("run", "batch_id", "partition", "offset")

# One row per finished batch of the hot table.
BATCH_SCHEMA = T.StructType([
    T.StructField("run", T.IntegerType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("input_rows", T.LongType()),
    T.StructField("accepted", T.LongType()),
    T.StructField("rejected", T.LongType()),
])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("compaction", T.StringType()),
    T.StructField("upto_run", T.IntegerType()),
    T.StructField("upto_batch", T.LongType()),
    T.StructField("cutoff", T.TimestampType()),
    T.StructField("rows", T.LongType()),
    T.StructField("min_ts", T.TimestampType()),
    T.StructField("max_ts", T.TimestampType()),
])

METRIC_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("name", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("le", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
])

# Fixed values that define the results.
LEVELS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL")
COLD_AGE = timedelta(hours=6)
HOT_RETENTION = timedelta(hours=24)
DEFAULT_RANGE = timedelta(hours=1)
DEFAULT_LIMIT = 1000
ARCHIVE_CHUNK = 10_000
STREAM_PARTITIONS = 12
BATCH_SECONDS = 2
MAX_QUEUE_DEPTH = 50_000
COOLDOWN = timedelta(seconds=30)
EVALUATION_STEP = timedelta(seconds=15)
# A series without a sample for this long is stale: what it held before no longer counts.
STALE_AFTER = timedelta(minutes=5)
RATE_WINDOW = timedelta(minutes=5)
