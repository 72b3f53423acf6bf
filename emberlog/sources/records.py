"""Encoded records: request bodies and stream values to entries, and entries to records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.codec import decode_array, decode_one, encode_entry
from emberlog.functions.routing import routing_key
from emberlog.functions.timefmt import fill_missing, micros
from emberlog.schema import LOG_COLUMNS, STREAM_PARTITIONS


def _now(as_of: datetime | str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.timestamp_micros(F.lit(micros(as_of)))


def decode_records(df: DataFrame, as_of: datetime | str | Column, value: str = "value",
                   error_type: str = "unmarshal", allow_trailing: bool = False) -> DataFrame:
    """One output row per input row: the entry columns plus `raw` and `error_type`.

    A rejected record keeps its raw text and has null entry columns; a good one has a null error.
    Other input columns are kept. `as_of` fills missing timestamps and may be a column.
    """
    kept = [c for c in df.columns if c != value and c not in LOG_COLUMNS]
    # `now` is resolved before the entry columns shadow a record's own timestamp.
    timed = df.select(*kept, F.col(value).alias("_value"), _now(as_of).alias("_now"))
    parsed, ok, entry = decode_one(timed, "_value", allow_trailing)
    entry["timestamp"] = fill_missing(entry["timestamp"], F.col("_now"))
    return parsed.select(
        *[F.when(ok, c).alias(n) for n, c in entry.items()], *kept,
        F.when(~ok, F.col("_value")).alias("raw"),
        F.when(~ok, F.lit(error_type)).alias("error_type"))


def good(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error_type").isNull()).drop("raw", "error_type")


def quarantined(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error_type").isNotNull()).drop(*LOG_COLUMNS)


def decode_bodies(df: DataFrame, as_of: datetime | str | Column, value: str = "value") -> DataFrame:
    """Batch bodies: other columns plus `entries`, null when the body as a whole is rejected."""
    kept = [c for c in df.columns if c != value]
    timed = df.select(*kept, F.col(value).alias("raw"), _now(as_of).alias("_now"))
    return decode_array(timed, "raw")


def explode_bodies(df: DataFrame, as_of: datetime | str | Column, value: str = "value") -> DataFrame:
    """One row per entry of the accepted bodies, with its index; all of a body share one fill time."""
    bodies = decode_bodies(df, as_of, value)
    kept = [c for c in bodies.columns if c not in ("raw", "_now", "entries")]
    exploded = bodies.select(*kept, "_now", F.posexplode("entries").alias("_index", "_entry"))
    filled = fill_missing(F.col("_entry.timestamp"), F.col("_now"))
    entry = [(filled if c == "timestamp" else F.col(f"_entry.{c}")).alias(c) for c in LOG_COLUMNS]
    return exploded.select(
        *kept, F.col("_index").cast("long").alias("entry_index"), *entry)


def rejected_bodies(df: DataFrame, as_of: datetime | str | Column, value: str = "value") -> DataFrame:
    bodies = decode_bodies(df, as_of, value).filter(F.col("entries").isNull())
    return bodies.drop("entries", "_now").withColumn("error_type", F.lit("decode"))


def acknowledgements(df: DataFrame, as_of: datetime | str | Column, value: str = "value") -> DataFrame:
    """Per body: `accepted`, and the number of entries ingested (0 for a rejected body)."""
    bodies = decode_bodies(df, as_of, value)
    return bodies.withColumn("accepted", F.col("entries").isNotNull()).withColumn(
        "ingested", F.when(F.col("accepted"), F.size("entries")).otherwise(F.lit(0)).cast("long")
    ).drop("raw", "_now", "entries")


def to_records(logs: DataFrame) -> DataFrame:
    """Entries as stream records (key, value, timestamp)."""
    return logs.select(
        routing_key(F.col("source"), F.col("trace_id")).alias("key"),
        encode_entry().alias("value"),
        F.col("timestamp").cast("timestamp").alias("timestamp"))


def stream_partition(key: Column, partitions: int = STREAM_PARTITIONS) -> Column:
    """Partition of a key: equal keys share one. The numbering is Spark's own hash."""
    return F.pmod(F.hash(key), F.lit(partitions))


def publish_files(records: DataFrame, path: str, partitions: int = STREAM_PARTITIONS) -> None:
    """Write records as Parquet, one directory per stream partition, without a shuffle: a hot key is
    written by as many tasks as hold its rows."""
    (records.withColumn("partition", stream_partition(F.col("key"), partitions))
     .write.mode("append").partitionBy("partition").parquet(path))


def publish_kafka(records: DataFrame, servers: str, topic: str) -> None:
    """Write records to Kafka (needs the Kafka connector on the class path).

    The sink sets the record time itself, so the entry's time travels as the header `timestamp`, as microseconds in text.
    """
    stamp = F.struct(F.lit("timestamp").alias("key"), F.unix_micros("timestamp").cast("string").cast("binary").alias("value"))
    (records.select("key", "value", F.array(stamp).alias("headers")).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic)
     .option("kafka.acks", "all").save())
