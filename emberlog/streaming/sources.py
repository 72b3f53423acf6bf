"""Streaming record sources. All of them yield (key, value, partition, offset, timestamp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.schema import RECORD_SCHEMA


def kafka_records(spark: SparkSession, servers: str, topic: str = "logs", max_offsets: int | None = None) -> DataFrame:
    """Kafka topic from its oldest offset; once a checkpoint exists it decides. Needs the connector.

    `max_offsets` bounds a micro-batch: under overload the reader slows down instead of shedding rows.
    """
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset", "timestamp")


def file_records(spark: SparkSession, path: str, max_files: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A growing folder of record files, for replays and tests; `max_files` bounds a micro-batch."""
    reader = spark.readStream.schema(RECORD_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)
