"""Stream to hot table: decode, quarantine, append, with replays that replace themselves."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from emberlog.schema import BATCH_SECONDS
from emberlog.sources.files import Folder
from emberlog.sources.records import decode_records
from emberlog.sources.tables import LogTables

BatchHandler = Callable[[DataFrame, int], None]


def triggered(writer: DataStreamWriter, available_now: bool, seconds: int = BATCH_SECONDS) -> DataStreamWriter:
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{seconds} seconds")


def run_batches(records: DataFrame, handler: BatchHandler, checkpoint: str, available_now: bool = False,
                seconds: int = BATCH_SECONDS, name: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to `handler(rows, batch_id)`; the offset is committed after it returns.

    A handler that fails fails the query, and the same batch is handed over again on restart.
    """
    writer = records.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return triggered(writer, available_now, seconds).start()


def decoded_stream(records: DataFrame, as_of: datetime | str | Column | None = None) -> DataFrame:
    """Decoded records with per-batch counts of accepted and rejected rows in the progress.

    Missing timestamps take the record's own timestamp, so that a replay fills the same value.
    """
    now = F.col("timestamp") if as_of is None else as_of
    return decode_records(records.drop("key"), now).observe(
        "ingest",
        F.count_if(F.col("error_type").isNull()).alias("accepted"),
        F.count_if(F.col("error_type").isNotNull()).alias("rejected"))


def ingest(records: DataFrame, tables: LogTables, checkpoint: str, run: int = 0, available_now: bool = False,
           as_of: datetime | str | Column | None = None, name: str | None = None) -> StreamingQuery:
    """Append a record stream to the hot table; `tables.batches()` has the counts of every batch.

    A run belongs to the streaming query that first wrote to it, by the id in its checkpoint: batch numbers start
    again with a new checkpoint, so it needs a new `run`, and the job fails before it replaces anything.
    """
    claimed = False

    def store(rows: DataFrame, batch_id: int) -> None:
        nonlocal claimed
        if not claimed:
            tables.claim(run, json.loads(Folder(tables.spark, checkpoint).read("metadata"))["id"])
            claimed = True
        tables.append(rows, batch_id, run)

    return run_batches(decoded_stream(records, as_of), store, checkpoint, available_now, name=name)
