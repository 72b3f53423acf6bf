"""A log of records in files: numbered offsets per partition, appended to by jobs and read as a stream or as a table.

An append writes Parquet files, one folder per partition, and then publishes one small entry that gives every file its place:
the records of a file follow those of the files before it, so a record's offset is its file's first offset plus its row. No
record is ranked or moved for that, and a partition with most of the records is written by many tasks. Readers
take only files that an entry names, so an append shows whole or not at all.

The stream knows offsets only: it starts at the earliest, its checkpoint decides from then on, and `max_offsets` bounds a
batch. Each file range of a batch is a task, which reads its rows as Arrow batches.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from emberlog.schema import RECORD_SCHEMA
from emberlog.sources.files import Folder

ARROW_SCHEMA = pa.schema([("key", pa.string()), ("value", pa.string()), ("partition", pa.int32()), ("offset", pa.int64()),
                          ("timestamp", pa.timestamp("us", "UTC"))])
SEGMENT_SCHEMA = "partition int, file string, first bigint, rows bigint"
#: Appends that run side by side number their entries anew when another one was first.
ATTEMPTS = 100


class RecordLog:
    """The log in a folder. Entries are `log/<n>.json`, one line per file; files are below `data`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, Folder(spark, path)

    def append(self, records: DataFrame) -> None:
        """Adds rows (key, value, partition, timestamp). Rows without a partition are refused. The driver sees one line per file."""
        batch = uuid.uuid4().hex
        placed = F.when(F.col("partition").isNull(), F.raise_error(F.lit("a record without a partition"))).otherwise(F.col("partition"))
        (records.select("key", "value", placed.cast("int").alias("partition"), F.col("timestamp").cast("timestamp").alias("timestamp"))
         .write.partitionBy("partition").parquet(self.folder.child(f"data/{batch}")))
        if not self.folder.glob(f"data/{batch}/partition=*"):
            return
        # Footers give the counts.
        written = (self.spark.read.schema("partition int").parquet(self.folder.child(f"data/{batch}"))
                   .groupBy("partition", F.col("_metadata.file_name").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
                   .orderBy("partition", "name").collect())
        for _ in range(ATTEMPTS):
            names = self.entries()
            ends = json.loads(self.folder.read(names[-1]).split("\n", 1)[0])["ends"] if names else {}
            lines = []
            for r in written:
                first = ends.get(str(r.partition), 0)
                lines.append(json.dumps({"partition": r.partition, "file": f"data/{batch}/partition={r.partition}/{r.name}", "first": first, "rows": r.rows}))
                ends[str(r.partition)] = first + r.rows
            if self.folder.publish(f"log/{len(names):012d}.json", "\n".join([json.dumps({"ends": ends}), *lines])):
                return
        raise RuntimeError("other appends were first each time")

    def entries(self) -> list[str]:
        return sorted(n for n in self.folder.glob("log/*.json"))

    def records(self) -> DataFrame:
        """All records as a table (key, value, partition, offset, timestamp)."""
        if not self.entries():
            return self.spark.createDataFrame([], RECORD_SCHEMA)
        segments = self.spark.read.schema(SEGMENT_SCHEMA).json(self.folder.child("log/*.json")).filter(F.col("file").isNotNull())
        files = (self.spark.read.schema("key string, value string, timestamp timestamp").option("recursiveFileLookup", True)
                 .parquet(self.folder.child("data")))
        rows = files.select("key", "value", "timestamp", F.regexp_extract("_metadata.file_path", "data/[^/]+/[^/]+/[^/]+$", 0).alias("file"),
                            F.col("_metadata.row_index").alias("_row"))
        return rows.join(segments, "file").select(
            "key", "value", "partition", (F.col("first") + F.col("_row")).alias("offset"), "timestamp")


@dataclass
class Range(InputPartition):
    """Rows [skip, skip + rows) of a file; the first of them has the offset `first`."""

    file: str
    partition: int
    first: int
    skip: int
    rows: int


class LogStreamReader(DataSourceStreamReader):
    """Offsets are {partition: next offset}; a partition that is missing begins at 0."""

    def __init__(self, path: str, most: int | None, checkpoint: str | None) -> None:
        self.path, self.most, self.checkpoint = path.rstrip("/"), most, checkpoint
        self.segments: list[dict] = []
        self.seen, self.ends = 0, {}
        self.position: dict[str, int] | None = None

    def __getstate__(self) -> dict:
        # Tasks need the path only.
        return {**self.__dict__, "segments": [], "seen": 0, "ends": {}}

    def initialOffset(self) -> dict:
        return {}

    def _refresh(self) -> None:
        store, base = fs.FileSystem.from_uri(self.path)
        listed = store.get_file_info(fs.FileSelector(f"{base}/log", allow_not_found=True))
        names = sorted(i.path for i in listed if re.fullmatch(r"\d{12}\.json", i.base_name))
        for name in names[self.seen:]:
            with store.open_input_stream(name) as stream:
                head, *lines = stream.read().decode().split("\n")
            self.ends = json.loads(head)["ends"]
            self.segments += map(json.loads, lines)
        self.seen = len(names)

    def _checkpointed(self) -> dict[str, int]:
        """The last offsets that a restarted query planned: they are the last line of its newest offset file."""
        if not self.checkpoint:
            return {}
        store, base = fs.FileSystem.from_uri(self.checkpoint.rstrip("/"))
        listed = store.get_file_info(fs.FileSelector(f"{base}/offsets", allow_not_found=True))
        names = {int(i.base_name): i.path for i in listed if i.base_name.isdigit()}
        if not names:
            return {}
        with store.open_input_stream(names[max(names)]) as stream:
            return json.loads(stream.read().decode().rstrip("\n").split("\n")[-1])

    def latestOffset(self) -> dict:
        """The end of the log or, with a bound, as much of every partition as its share of what is left."""
        self._refresh()
        if self.position is None:
            self.position = self._checkpointed()
        left = {p: end - self.position.get(p, 0) for p, end in self.ends.items()}
        total, upto, taken, target = sum(left.values()), 0, 0, {}
        most = total if self.most is None else min(self.most, total)
        for p in sorted(left, key=int):
            upto += left[p]
            share = most * upto // total if total else 0
            if (here := self.position.get(p, 0) + share - taken):
                target[p] = here
            taken = share
        self.position = target
        return target

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self._refresh()
        found = []
        for s in self.segments:
            p = str(s["partition"])
            low, high = max(start.get(p, 0), s["first"]), min(end.get(p, 0), s["first"] + s["rows"])
            if low < high:
                found.append(Range(s["file"], s["partition"], low, low - s["first"], high - low))
        return found

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as source:
            # Spark's default for times in Parquet is a type that is read as nanoseconds unless told otherwise.
            file = pq.ParquetFile(source, coerce_int96_timestamp_unit="us")
            groups, at, skip = [], 0, partition.skip
            for g in range(file.num_row_groups):
                n = file.metadata.row_group(g).num_rows
                if at + n <= partition.skip:
                    skip -= n
                elif at < partition.skip + partition.rows:
                    groups.append(g)
                at += n
            first, left = partition.first, partition.rows
            for batch in file.iter_batches(row_groups=groups, columns=["key", "value", "timestamp"]):
                rows = batch.slice(skip, left)
                skip = max(skip - batch.num_rows, 0)
                n = rows.num_rows
                if not n:
                    continue
                offsets = pa.array(range(first, first + n), pa.int64())
                times = rows.column("timestamp").cast(pa.timestamp("us")).cast(pa.int64()).cast(pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("key").cast(pa.string()), rows.column("value").cast(pa.string()), pa.array([partition.partition] * n, pa.int32()),
                     offsets, times], schema=ARROW_SCHEMA)
                first, left = first + n, left - n


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "emberlog_records"

    def schema(self) -> StructType:
        return RECORD_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        most = self.options.get("max_offsets")
        return LogStreamReader(self.options["path"], int(most) if most else None, self.options.get("checkpoint"))


def log_records(spark: SparkSession, path: str, max_offsets: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """The log as a stream from its earliest record; once a checkpoint exists it decides.

    `max_offsets` bounds a batch. A restarted query learns where it stood from its `checkpoint` folder, which a bounded
    stream therefore has to name; it must then be the query's only source. Spark ends a run with `availableNow` after one
    batch of such a source, so a bounded stream is run with a processing time.
    """
    if max_offsets and not checkpoint:
        raise ValueError("a bounded stream needs the folder of its checkpoint")
    spark.dataSource.register(LogSource)
    reader = spark.readStream.format(LogSource.name()).option("path", path)
    if max_offsets:
        reader = reader.option("max_offsets", max_offsets).option("checkpoint", checkpoint)
    return reader.load()
