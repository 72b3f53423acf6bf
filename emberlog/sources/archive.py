"""Archive objects: gzip files that each hold one JSON array of entries in ascending time order.

This is an exchange format. A gzip array cannot be split or filtered before it is decoded, so the
cold table itself is Parquet.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.codec import decode_array, encode_entry
from emberlog.functions.timefmt import object_key
from emberlog.operators.ordered import SEQ_BLOCK, global_rank
from emberlog.schema import ARCHIVE_CHUNK, LOG_COLUMNS


def chunks(logs: DataFrame, seq: str = "ingest_seq", chunk_rows: int = ARCHIVE_CHUNK, block: int = SEQ_BLOCK) -> DataFrame:
    """One row per archive object: `chunk`, `object`, `entry_count`, bounds and the JSON array `value`.

    Chunks are runs of `chunk_rows` rows in arrival order, each sorted by time; a chunk is the most
    that one group ever holds. `seq` is a unique integer arrival number.
    """
    ranked = global_rank(logs, seq, "_rank", block)
    entry = F.struct(
        F.col("timestamp").cast("timestamp").alias("timestamp"), F.col(seq).alias("seq"),
        encode_entry().alias("json"))
    return (
        ranked.withColumn("chunk", F.floor((F.col("_rank") - 1) / F.lit(chunk_rows)).cast("long"))
        .groupBy("chunk").agg(
            F.sort_array(F.collect_list(entry)).alias("_rows"), F.count(F.lit(1)).alias("entry_count"),
            F.min(F.col("timestamp").cast("timestamp")).alias("start_time"),
            F.max(F.col("timestamp").cast("timestamp")).alias("end_time"))
        .select(
            "chunk", object_key(F.col("start_time")).alias("object"), "entry_count", "start_time", "end_time",
            F.concat(F.lit("["), F.array_join(F.transform("_rows", lambda r: r["json"]), ","), F.lit("]"))
            .alias("value"),
        )
    )


def write_archive(logs: DataFrame, path: str, seq: str = "ingest_seq", chunk_rows: int = ARCHIVE_CHUNK,
                  block: int = SEQ_BLOCK) -> None:
    """Write one gzip object per chunk below `path/dt=<date of the first row>/`.

    The file names are Spark's, so chunks that share a first timestamp do not overwrite each other.
    """
    objects = chunks(logs, seq, chunk_rows, block).select("value", F.to_date("start_time").alias("dt"))
    (objects.write.mode("append").partitionBy("dt")
     .option("compression", "gzip").option("maxRecordsPerFile", 1).text(path))


@F.pandas_udf(T.StringType())
def _gunzip(content: pd.Series) -> pd.Series:
    """Text of gzip bytes; null where they are not gzip, or damaged."""
    def text(data: bytes) -> str | None:
        try:
            return gzip.decompress(data).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None
    return content.map(text, na_action="ignore")


def _objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per object: its path, whether it is `whole` gzip, and its decoded entries, null when any element is bad.

    Reading and unpacking are apart: bytes that cannot be read fail the task, which is tried again, and in the end the
    job, so that an object is never skipped for a passing error of the store.
    """
    content = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    text = content.select(F.col("_metadata.file_path").alias("object"), _gunzip("content").alias("value"))
    kept = text.select("object", F.col("value").isNotNull().alias("whole"), "value")
    return decode_array(kept, "value")


def read_archive(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of all acceptable objects. An object that is not gzip, not an array of entries, or has
    one bad element is skipped as a whole; `skipped_objects` lists those."""
    return _objects(spark, paths).select("object", F.inline("entries")).select(*LOG_COLUMNS, "object")


def skipped_objects(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(object, reason) of the objects that `read_archive` skips: `gzip` or `entries` is what cannot be read."""
    reason = F.when(F.col("whole"), "entries").otherwise("gzip").alias("reason")
    return _objects(spark, paths).filter(F.col("entries").isNull()).select("object", reason)
