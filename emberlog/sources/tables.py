"""The hot and cold tables and the manifest that moves rows between them.

Layout below the root:

    hot/new/<run>-<batch>-<token>-<i>.parquet   good rows of stream micro-batches, one flat folder
    hot/commits/<run>-<batch>-<token>.json      one small file per finished batch, with its counts
    hot/segments/<n>-<token>/                   young rows that a compaction has merged into larger files
    bad/<run>-<batch>-<token>-<i>.parquet       rejected records
    cold/compaction=<n>-<token>/dt=<date>/      one directory per compaction
    cold-index/<n>-<token>/                     what searches must know of its files (`objects.INDEX_SCHEMA`)
    manifest/<n>.json                           one snapshot per committed compaction or eviction
    runs/<run>.json                             which streaming query owns a run
    batches/                                    counts of batches whose files have been cleaned up

A snapshot names everything that searches read besides the new files: the batches it has absorbed, as ranges per
run, the segments, the cutoff, and the cold directories. A reader takes one snapshot and uses it for both
tiers, so a compaction that commits in between changes nothing for it: absorbed files stay until `clean`. A batch counts as
absorbed only if a compaction has read it, whatever the order in which batches and runs arrive. A compaction
that fails leaves files that no snapshot names: nothing is lost or doubled.

A batch becomes visible, whole, by the one file that commits it: the token in its name is that of the batch's files, and files
of other tokens are not read. Each attempt at a batch has a greater token, so a replay replaces the batch in that one step too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.timefmt import micros, rfc3339_seconds, utc
from emberlog.functions.zorder import cut_points, interleaved
from emberlog.plans.progressive import Found, Part, first_rows
from emberlog.plans.query import LogQuery
from emberlog.plans.search import pick_order, search
from emberlog.schema import (
    ARRIVAL, BATCH_SCHEMA, COLD_AGE, COLD_SCHEMA, HOT_RETENTION, HOT_SCHEMA, LOG_COLUMNS, MANIFEST_SCHEMA,
)
from emberlog.sources.files import Folder
from emberlog.sources.objects import INDEX_SCHEMA, DataObject, candidates, summarise

#: A compaction without aged rows still merges new files once there are this many batches.
MERGE_BATCHES = 100
#: Cold directories of one size that are merged into one.
FANOUT = 8
#: Rows that stay together when full objects are dealt to tasks, if an object has fewer, and those that a task writes at most on average.
PIECE_ROWS, TASK_ROWS = 2_000, 1_000_000


def _iso(us: int) -> str:
    return (datetime(1970, 1, 1) + timedelta(microseconds=us)).isoformat(timespec="microseconds") + "Z"


@dataclass(frozen=True)
class Snapshot:
    """What the compactions so far have committed."""

    n: int = -1
    cutoff_us: int | None = None
    absorbed: dict[int, list[list[int]]] = field(default_factory=dict)
    segments: list[dict] = field(default_factory=list)
    cold: list[dict] = field(default_factory=list)

    def holds(self, run: int, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi in self.absorbed.get(run, []))

    def moved(self) -> Column:
        """Is a row of a batch that has been absorbed?"""
        held = F.lit(False)
        for run, ranges in self.absorbed.items():
            for lo, hi in ranges:
                held = held | ((F.col("run") == run) & F.col("batch_id").between(lo, hi))
        return held

    def young(self) -> Column:
        """Is a row of a segment still hot? Rows without a timestamp never age."""
        if self.cutoff_us is None:
            return F.lit(True)
        return F.col("timestamp").isNull() | (F.col("timestamp") >= F.timestamp_micros(F.lit(self.cutoff_us)))


def _batch_of(path: str) -> tuple[int, int, str]:
    """(run, batch_id, token) of a file of a batch or of its commit."""
    run, batch, token = path.rsplit("/", 1)[1].split(".")[0].split("-")[:3]
    return int(run), int(batch), token


COMMIT_SCHEMA = T.StructType([*BATCH_SCHEMA.fields, T.StructField("token", T.StringType())])


def _merged(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges joined where they touch."""
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _stats() -> list[Column]:
    us = F.unix_micros("timestamp")
    return [F.count(F.lit(1)).alias("rows"), F.min(us).alias("min_us"), F.max(us).alias("max_us"),
            F.count_if(F.col("timestamp").isNull()).alias("nulls")]


@dataclass(frozen=True)
class FirstFound:
    """A limited result and what was read for it; a tier that was not read in parts has no report."""

    rows: DataFrame
    hot: Found | None
    cold: Found | None


class LogTables:
    """The tables below one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
            raise ValueError("dates are UTC: set spark.sql.session.timeZone to UTC")
        self.spark = spark
        self.folder = Folder(spark, root)
        self.root = self.folder.path

    # ---- new batches --------------------------------------------------------------------------

    def claim(self, run: int, owner: str) -> None:
        """Bind a run to one writer. A second one would overwrite the first one's batches, so it is refused."""
        if not self.folder.publish(f"runs/{run}.json", json.dumps({"owner": owner})):
            known = json.loads(self.folder.read(f"runs/{run}.json"))["owner"]
            if known != owner:
                raise RuntimeError(f"run {run} belongs to writer {known}: a new checkpoint needs a new run")

    def append(self, decoded: DataFrame, batch_id: int, run: int = 0) -> dict:
        """Store one decoded batch, good and rejected rows, replacing an earlier attempt; returns its counts.

        Rows need LOG columns and may have partition, offset, raw and error_type. Without offsets the
        position inside the batch is the row's place in the input. A batch that a compaction has absorbed is
        already stored and left as it is.
        """
        earlier = self.folder.glob(f"hot/commits/{run}-{batch_id}-*.json")
        if self.snapshot().holds(run, batch_id):
            return json.loads(self.folder.read(max(earlier))) if earlier else {"run": run, "batch_id": batch_id}
        columns = set(decoded.columns)
        partition = F.col("partition").cast("int") if "partition" in columns else F.lit(0)
        offset = F.col("offset").cast("long") if "offset" in columns else F.monotonically_increasing_id()
        raw = F.col("raw") if "raw" in columns else F.lit(None).cast("string")
        error = F.col("error_type") if "error_type" in columns else F.lit(None).cast("string")
        seen = Observation(f"batch-{run}-{batch_id}-{uuid.uuid4().hex[:8]}")
        rows = decoded.select(
            *LOG_COLUMNS, partition.alias("partition"), offset.alias("offset"), raw.alias("raw"), error.alias("error_type"),
            F.lit(run).cast("int").alias("run"), F.lit(batch_id).cast("long").alias("batch_id"),
            F.when(error.isNull(), "ok").otherwise("bad").alias("status"))
        counted = rows.observe(seen, F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("status") == "ok").alias("accepted"),
                               F.count_if(F.col("status") == "bad").alias("rejected"))
        # Tokens grow from attempt to attempt, so that of two commits the later one counts.
        attempt = 1 + max((int(_batch_of(path)[2][:6]) for path in earlier), default=0)
        token = f"{attempt:06d}{uuid.uuid4().hex[:8]}"
        aside = f"hot/tmp/{run}-{batch_id}-{token}"
        counted.write.partitionBy("status").parquet(self.folder.child(aside))
        for status, folder in (("ok", "hot/new"), ("bad", "bad")):
            for i, part in enumerate(self.folder.glob(f"{aside}/status={status}/*.parquet")):
                self.folder.move(part, f"{folder}/{run}-{batch_id}-{token}-{i}.parquet")
        row = {"run": run, "batch_id": batch_id, **seen.get}
        if not self.folder.publish(f"hot/commits/{run}-{batch_id}-{token}.json", json.dumps(row | {"token": token})):
            raise RuntimeError(f"batch {batch_id} of run {run} could not be committed")
        for old in earlier:
            self.folder.delete(old)
        for folder in ("hot/new", "bad"):
            for old in self.folder.glob(f"{folder}/{run}-{batch_id}-*"):
                if _batch_of(old)[2] != token:
                    self.folder.delete(old)
        self.folder.delete(aside)
        return row

    def _commits(self) -> dict[tuple[int, int], str]:
        """Token of each finished batch whose files are still there, by (run, batch_id), from one listing."""
        found = [_batch_of(path) for path in self.folder.glob("hot/commits/*.json")]
        return {(run, batch): token for run, batch, token in sorted(found)}

    def _committed(self) -> list[tuple[int, int]]:
        """(run, batch_id) of the finished batches whose files are still there."""
        return sorted(self._commits())

    def committed_batch(self) -> tuple[int, int] | None:
        """Largest (run, batch_id) whose write has finished, cleaned up or not."""
        absorbed = [(run, ranges[-1][1]) for run, ranges in self.snapshot().absorbed.items()]
        return max([*self._committed(), *absorbed], default=None)

    def batches(self) -> DataFrame:
        """Per finished batch: rows read, accepted and rejected. A replay replaces its row."""
        found = self.spark.createDataFrame([], COMMIT_SCHEMA)
        if self.folder.exists("hot/commits"):
            found = found.unionByName(self._commit_rows())
        if self.folder.exists("batches"):
            found = found.unionByName(self.spark.read.schema(COMMIT_SCHEMA).parquet(self.folder.child("batches")))
        # A replay or a clean-up that was interrupted may have left two rows.
        counts = [f.name for f in BATCH_SCHEMA if f.name not in ("run", "batch_id")]
        return found.groupBy("run", "batch_id").agg(*[F.max_by(c, F.coalesce("token", F.lit(""))).alias(c) for c in counts])

    def _commit_rows(self) -> DataFrame:
        return self.spark.read.schema(COMMIT_SCHEMA).option("pathGlobFilter", "*.json").json(self.folder.child("hot/commits"))

    def _flat(self, folder: str) -> DataFrame:
        """Rows of the committed files of a flat folder.

        Commits are listed before the files, so all files of a batch that counts as committed are there. The names of files
        that no commit names, which a running or a dead job left, become a filter on the files.
        """
        commits = self._commits()
        if not self.folder.exists(folder):
            return self.spark.createDataFrame([], HOT_SCHEMA)
        rows = self.spark.read.schema(HOT_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(self.folder.child(folder))
        hidden = [path.rsplit("/", 1)[1] for path in self.folder.glob(f"{folder}/*.parquet")
                  if commits.get(_batch_of(path)[:2]) != _batch_of(path)[2]]
        return rows.filter(~F.col("_metadata.file_name").isin(hidden)) if hidden else rows

    def quarantine(self) -> DataFrame:
        """Rejected records: raw text, reason and position."""
        return self._flat("bad").select("raw", "error_type", *ARRIVAL)

    # ---- hot ----------------------------------------------------------------------------------

    def _new(self, snapshot: Snapshot) -> DataFrame:
        """Rows of batches that no compaction has absorbed. One listing of one folder, whatever the number of batches."""
        return self._flat("hot/new").filter(~snapshot.moved()).select(*LOG_COLUMNS, *ARRIVAL)

    def _segments(self, segments: list[dict]) -> DataFrame:
        paths = [self.folder.child(f"hot/segments/{s['name']}") for s in segments]
        rows = self.spark.read.schema(HOT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], HOT_SCHEMA)
        return rows.select(*LOG_COLUMNS, *ARRIVAL)

    def hot(self, snapshot: Snapshot | None = None) -> DataFrame:
        """Good rows that are not in cold and have not been evicted.

        New files are chosen by batch, segments by the cutoff; both bounds reach the Parquet scan.
        """
        at = self.snapshot() if snapshot is None else snapshot
        return self._new(at).unionByName(self._segments(at.segments).filter(at.young()))

    def stored(self) -> DataFrame:
        """Every good row, hot or cold, that has not been evicted."""
        at = self.snapshot()
        return self.hot(at).unionByName(self.cold(snapshot=at).select(*LOG_COLUMNS, *ARRIVAL))

    # ---- manifest -----------------------------------------------------------------------------

    def _snapshot_numbers(self) -> list[int]:
        return [int(n.split("/")[1].split(".")[0]) for n in self.folder.glob("manifest/*.json")]

    def snapshot(self) -> Snapshot:
        """The newest snapshot, read without a Spark job."""
        numbers = self._snapshot_numbers()
        if not numbers:
            return Snapshot()
        row = json.loads(self.folder.read(f"manifest/{max(numbers)}.json"))
        return Snapshot(row["n"], row["cutoff_us"], {int(r): v for r, v in row["absorbed"].items()}, row["segments"], row["cold"])

    def manifest(self, snapshot: Snapshot | None = None) -> DataFrame:
        """One row per committed compaction."""
        at = self.snapshot() if snapshot is None else snapshot
        if at.n < 0:
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)
        listed = T.StructType([T.StructField("cold", T.ArrayType(MANIFEST_SCHEMA))])
        return self.spark.read.schema(listed).json(self.folder.child(f"manifest/{at.n}.json")).select(F.inline("cold"))

    # ---- cold ---------------------------------------------------------------------------------

    def cold(self, start: datetime | str | None = None, end: datetime | str | None = None,
             snapshot: Snapshot | None = None, query: LogQuery | None = None) -> DataFrame:
        """Rows of the committed compactions, only those whose time span meets the range.

        The snapshot has one entry per compaction (48 a day at the default interval); the names of the
        directories to read come from it, without a job or a listing. With a `query` that names a source, a level or a text, only
        the files that the index does not rule out are read.
        """
        at = self.snapshot() if snapshot is None else snapshot
        entries = self._cold_entries(at, start, end)
        if query is not None and (query.source or query.level or query.text):
            indexed = [c for c in entries if c.get("indexed")]
            others = [f"cold/compaction={c['compaction']}" for c in entries if not c.get("indexed")]
            return self._read_cold([*[o.path for o in self._candidates(indexed, query, start, end)], *others])
        return self._read_cold([f"cold/compaction={c['compaction']}" for c in entries])

    @staticmethod
    def _cold_entries(at: Snapshot, start: datetime | str | None, end: datetime | str | None) -> list[dict]:
        low, high = (None if t is None else micros(utc(t)) for t in (start, end))
        return [c for c in at.cold if (low is None or micros(c["max_ts"]) >= low) and (high is None or micros(c["min_ts"]) <= high)]

    def _read_cold(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], COLD_SCHEMA)
        return (self.spark.read.schema(COLD_SCHEMA).option("basePath", self.folder.child("cold"))
                .parquet(*[self.folder.child(path) for path in paths]))

    def _candidates(self, entries: list[dict], query: LogQuery, start: datetime | str | None, end: datetime | str | None) -> list[DataObject]:
        if not entries:
            return []
        paths = [self.folder.child(f"cold-index/{c['compaction']}") for c in entries]
        return candidates(self.spark.read.schema(INDEX_SCHEMA).parquet(*paths), query, start, end)

    def objects(self, query: LogQuery, as_of: datetime | str, snapshot: Snapshot | None = None) -> list[DataObject]:
        """The indexed cold files that may hold a match of the query, in order of their first time."""
        at, bounded = self.snapshot() if snapshot is None else snapshot, query.with_defaults(as_of)
        entries = self._cold_entries(at, bounded.start, bounded.end)
        return self._candidates([c for c in entries if c.get("indexed")], bounded, bounded.start, bounded.end)

    def _to_index(self, target: str, name: str) -> None:
        """Summaries of the files of a directory just written, with paths relative to the root."""
        files = self.spark.read.schema(COLD_SCHEMA).option("basePath", self.folder.child("cold")).parquet(self.folder.child(target))
        # Small objects would make a task, and a file of the index, of every 32.
        lines = summarise(files.coalesce(4 * self.spark.sparkContext.defaultParallelism))
        relative = F.concat(F.lit(f"{target}/"), F.element_at(F.split("object", f"{target}/"), -1))
        lines.withColumn("object", relative).write.parquet(self.folder.child(f"cold-index/{name}"))

    def compact(self, as_of: datetime | str, cold_age: timedelta = COLD_AGE, files: int | None = None,
                rows_per_file: int = 0, cluster: Sequence[str] = ()) -> dict | None:
        """Move visible hot rows older than the cold age; returns the manifest row, None when there are none.

        Rows are range-partitioned by (dt, timestamp, arrival), so a hot day, or many rows that share
        one timestamp, spread over several files, and every file covers a narrow time range.
        `rows_per_file` is the objects' rows (0: one object per task and day): all objects are full but for the last one of a day, however
        many tasks write them, and `files`, the number of tasks, is for compactions without it. With `cluster` (columns such as source
        and level) the days are laid out along the interleaved bits of those columns and the time instead, so that a
        search for one of their values reads few files, and one for a time some more. The young rows of the new
        batches are merged into a segment, so a row is written three times at most: new, segment, cold.
        """
        return self._advance(micros(utc(as_of) - cold_age), True, files, rows_per_file, tuple(cluster))

    def evict(self, as_of: datetime | str, retention: timedelta = HOT_RETENTION) -> int:
        """Discard hot rows past retention, also out of batches that hold younger rows; returns how many.

        Rows of new batches within retention that are behind the cutoff of an earlier compaction go to cold.
        """
        row = self._advance(micros(utc(as_of) - retention), False, None, 0)
        return row["rows"] if row else 0

    def _advance(self, cutoff_us: int, keep: bool, files: int | None, rows_per_file: int, cluster: tuple[str, ...] = ()) -> dict | None:
        """Absorb the finished new batches: rows before the cutoff go to cold (or nowhere), the others to a segment.

        Only rows before the requested cutoff go nowhere, not those between it and a later one of the snapshot.
        """
        at = self.snapshot()
        fresh = [(run, batch) for run, batch in self._committed() if not at.holds(run, batch)]
        # The cutoff only grows, and with it what is out of the segments.
        requested_us, cutoff_us = cutoff_us, cutoff_us if at.cutoff_us is None else max(cutoff_us, at.cutoff_us)
        dated = [s for s in at.segments if s["min_us"] is not None and s["min_us"] < cutoff_us]
        if not fresh and not dated:
            return None
        number = at.n + 1
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        taken = Snapshot(absorbed={run: _merged([[b, b] for r, b in fresh if r == run]) for run in {r for r, _ in fresh}})
        absorbed = at.absorbed | {run: _merged([*at.absorbed.get(run, []), *ranges]) for run, ranges in taken.absorbed.items()}
        new = self._new(at).filter(taken.moved())
        is_aged, is_past = (F.coalesce(F.col("timestamp") < F.timestamp_micros(F.lit(us)), F.lit(False)) for us in (cutoff_us, requested_us))
        aged = new.unionByName(self._segments(dated).filter(at.young())).filter(is_aged)
        target, segment = f"cold/compaction={name}", f"hot/segments/{name}"
        stats = self._to_cold(aged, target, files, rows_per_file, cluster) if keep else aged.filter(is_past).agg(*_stats()).first().asDict()
        if not stats["rows"] and len(fresh) < MERGE_BATCHES:
            self.folder.delete(target)
            return None
        moved = stats if keep else {"rows": 0}
        if not keep and requested_us < cutoff_us:
            moved = self._to_cold(aged.filter(~is_past), target, files, rows_per_file)
        if moved["rows"]:
            self._to_index(target, name)
        else:
            self.folder.delete(target)
        kept = self._to_segment(new.filter(~is_aged), segment)
        if not kept["rows"]:
            self.folder.delete(segment)
        segments = [s for s in at.segments if s["nulls"] or s["max_us"] >= cutoff_us]
        if kept["rows"]:
            segments.append({"name": name, **{k: kept[k] for k in ("rows", "min_us", "max_us", "nulls")}})
        last = max([(run, ranges[-1][1]) for run, ranges in absorbed.items()], default=(0, -1))
        row = {"n": number, "compaction": name, "upto_run": last[0], "upto_batch": last[1], "cutoff": _iso(cutoff_us), "rows": stats["rows"]}
        cold = list(at.cold)
        if moved["rows"]:
            cold.append(row | {"rows": moved["rows"], "min_ts": _iso(moved["min_us"]), "max_ts": _iso(moved["max_us"]), "indexed": True})
        state = {"n": number, "cutoff_us": cutoff_us, "absorbed": absorbed, "segments": segments, "cold": cold}
        if not self.folder.publish(f"manifest/{number}.json", json.dumps(state)):
            for left in (target, segment, f"cold-index/{name}"):
                self.folder.delete(left)
            raise RuntimeError(f"snapshot {number} was committed by another job; nothing was moved here")
        if not stats["rows"]:
            return None
        return cold[-1] if keep else row

    def _to_cold(self, aged: DataFrame, target: str, files: int | None, rows_per_file: int, cluster: tuple[str, ...] = ()) -> dict:
        order = ["dt", "timestamp", *ARRIVAL]
        rows = aged.withColumn("dt", F.to_date("timestamp")).select(*LOG_COLUMNS, *ARRIVAL, "dt")
        if cluster:
            # Ranks are those of the whole compaction; a day holds a range of the times' ranks.
            rows = rows.withColumn("_place", interleaved(cut_points(rows, [*cluster, "timestamp"], ARRIVAL)))
            order = ["dt", "_place", "timestamp", *ARRIVAL]
        # Objects that must be full follow the order, not the tasks.
        ranged = rows.repartitionByRange(files, *order) if files and not rows_per_file else rows.repartitionByRange(*order)
        seen = Observation(f"cold-{uuid.uuid4().hex[:8]}")
        placed = ranged.sortWithinPartitions(*order).observe(seen, *_stats()).drop("_place")
        if rows_per_file:
            aside = f"hot/tmp/{target.rsplit('=', 1)[1]}"
            placed.withColumn("_at", F.monotonically_increasing_id()).write.parquet(self.folder.child(aside))
            if seen.get["rows"]:
                self._full_objects(aside, target, rows_per_file, seen.get["rows"])
            self.folder.delete(aside)
        else:
            self._in_days(placed, target)
        return seen.get

    def _in_days(self, rows: DataFrame, target: str, **options: str | int) -> None:
        # Tasks put their files in place themselves: for a directory that no snapshot names yet that is safe, and the
        # driver does not rename thousands of objects one by one.
        (rows.write.partitionBy("dt").options(**{"mapreduce.fileoutputcommitter.algorithm.version": "2"}, **options)
         .parquet(self.folder.child(target)))

    def _full_objects(self, aside: str, target: str, rows_per_file: int, count: int) -> None:
        """Write ordered rows as objects of `rows_per_file` rows, the last one of a day with the rest.

        `_at` counts the rows of each ordered partition, so one line per day and partition tells a row's rank in its day. Runs of whole
        objects are dealt to tasks: no task holds a day.
        """
        schema = T.StructType([f for f in COLD_SCHEMA.fields if f.name != "compaction"] + [T.StructField("_at", T.LongType())])
        rows = self.spark.read.schema(schema).parquet(self.folder.child(aside)).withColumn("_part", F.shiftright("_at", 33))
        before = Window.partitionBy("dt").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        # Rank of a row: its place since the first one of its day in the partition, and the rows of the day in partitions before.
        starts = (rows.groupBy("dt", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
                  .select("dt", "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_zero")))
        run = rows_per_file * max(1, PIECE_ROWS // rows_per_file)
        pieces = rows.join(F.broadcast(starts), ["dt", "_part"]).withColumn("_piece", F.floor((F.col("_at") - F.col("_zero")) / F.lit(run)))
        # A number of tasks by cores and rows: by their bytes alone, a million rows in small objects would be few tasks.
        tasks = min(-(-count // run), max(4 * self.spark.sparkContext.defaultParallelism, count // TASK_ROWS))
        ordered = pieces.repartition(tasks, "dt", "_piece").sortWithinPartitions("dt", "_at")
        self._in_days(ordered.drop("_part", "_zero", "_piece", "_at"), target, maxRecordsPerFile=rows_per_file)

    def _to_segment(self, young: DataFrame, target: str) -> dict:
        # Time order within files keeps the bounds of row groups narrow; AQE joins small tasks into few files.
        seen = Observation(f"segment-{uuid.uuid4().hex[:8]}")
        (young.repartitionByRange("timestamp", *ARRIVAL).sortWithinPartitions("timestamp", *ARRIVAL)
         .observe(seen, *_stats()).write.parquet(self.folder.child(target)))
        return seen.get

    def merge_cold(self, fanout: int = FANOUT, files: int | None = None, rows_per_file: int = 0, cluster: Sequence[str] = ()) -> int:
        """Merge cold directories of about one size until fewer than `fanout` of each size are left; returns how many were merged.

        Sizes are powers of `fanout` in rows, so there are logarithmically many directories (and snapshot entries) for any number
        of compactions, and a row is written again at most once per size. A merge is one snapshot: readers see
        the old directories or the new one, and `clean` deletes the old ones. The merged entry stands for the compactions
        that it holds in the manifest, with their rows and bounds.
        """
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        merged = 0
        while True:
            at = self.snapshot()
            sizes: dict[int, list[dict]] = {}
            for entry in at.cold:
                level = 0
                while entry["rows"] >= fanout ** (level + 1):
                    level += 1
                sizes.setdefault(level, []).append(entry)
            full = min((level for level, entries in sizes.items() if len(entries) >= fanout), default=None)
            if full is None:
                return merged
            self._merge(at, sizes[full], files, rows_per_file, tuple(cluster))
            merged += len(sizes[full])

    def _merge(self, at: Snapshot, entries: list[dict], files: int | None, rows_per_file: int, cluster: tuple[str, ...]) -> None:
        number = at.n + 1
        name = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        target = f"cold/compaction={name}"
        old = self._read_cold([f"cold/compaction={c['compaction']}" for c in entries]).select(*LOG_COLUMNS, *ARRIVAL)
        stats = self._to_cold(old, target, files, rows_per_file, cluster)
        if stats["rows"] != sum(c["rows"] for c in entries):
            self.folder.delete(target)
            raise RuntimeError(f"the directories to merge hold {stats['rows']} rows, not those of the snapshot; nothing was merged")
        self._to_index(target, name)
        newest = max(entries, key=lambda c: c["n"])
        row = newest | {"n": number, "compaction": name, "rows": stats["rows"], "min_ts": _iso(stats["min_us"]),
                        "max_ts": _iso(stats["max_us"]), "indexed": True}
        gone = {c["compaction"] for c in entries}
        state = {"n": number, "cutoff_us": at.cutoff_us, "absorbed": at.absorbed, "segments": at.segments,
                 "cold": [c for c in at.cold if c["compaction"] not in gone] + [row]}
        if not self.folder.publish(f"manifest/{number}.json", json.dumps(state)):
            for left in (target, f"cold-index/{name}"):
                self.folder.delete(left)
            raise RuntimeError(f"snapshot {number} was committed by another job; nothing was merged here")

    def clean(self) -> int:
        """Delete the files that the newest snapshot does not need: absorbed batches, dropped segments, and what failed jobs
        have left; returns the number of batches. Meant to run while no compaction runs and no older snapshot is read.
        """
        at = self.snapshot()
        gone = [(run, batch) for run, batch in self._committed() if at.holds(run, batch)]
        if gone:
            done = self._commit_rows().filter(at.moved())
            done.coalesce(1).write.mode("append").parquet(self.folder.child("batches"))
        files: dict[tuple[int, int], list[str]] = {}
        for path in self.folder.glob("hot/new/*.parquet"):
            files.setdefault(_batch_of(path)[:2], []).append(path)
        for run, batch in gone:
            for path in files.get((run, batch), []):
                self.folder.delete(path)
            for path in self.folder.glob(f"hot/commits/{run}-{batch}-*.json"):
                self.folder.delete(path)
        named = {f"hot/segments/{s['name']}" for s in at.segments}
        named |= {f"{folder}{c['compaction']}" for c in at.cold for folder in ("cold/compaction=", "cold-index/")}
        for pattern in ("hot/segments/*", "cold/compaction=*", "cold-index/*"):
            for path in self.folder.glob(pattern):
                if path not in named:
                    self.folder.delete(path)
        for n in self._snapshot_numbers():
            if n < at.n:
                self.folder.delete(f"manifest/{n}.json")
        return len(gone)

    # ---- search -------------------------------------------------------------------------------

    def search(self, query: LogQuery, as_of: datetime | str, cold_age: timedelta = COLD_AGE) -> DataFrame:
        """`search` over both tables; cold directories outside the range are not even listed."""
        bounded = query.with_defaults(as_of)
        route = bounded.route(as_of, cold_age)
        # One snapshot for both tiers: a compaction that commits meanwhile must not hide what it moves.
        at = self.snapshot()
        cold = self.cold(bounded.start, bounded.end, at, bounded) if route.needs_cold else self.cold_nothing()
        return search(self.hot(at), cold, bounded, as_of, cold_age, arrival=ARRIVAL)

    def search_first(self, query: LogQuery, as_of: datetime | str, cold_age: timedelta = COLD_AGE) -> FirstFound:
        """The rows of `search`, found by reading each tier in the order of the result and stopping at the limit.

        Cold files go by their first time (their last one for order 'newest'), new hot batches by their number, as arrival
        order does; segments, which hold older arrivals, come first. A part is left unread once the limit is full and
        nothing in it can win. This runs a job per slice at once, where `search` is one lazy plan over all candidates.
        """
        bounded = query.with_defaults(as_of)
        route = bounded.route(as_of, cold_age)
        at = self.snapshot()
        newest = bounded.order == "newest"
        cold = self._first_cold(replace(bounded, end=route.cutoff) if route.needs_hot else bounded, as_of, at, newest) if route.needs_cold else None
        hot = self._first_hot(bounded, at) if not newest else None
        rows = search(
            self.hot(at) if hot is None else self._hot_nothing() if hot.rows is None else hot.rows,
            self.cold_nothing() if cold is None or cold.rows is None else cold.rows, bounded, as_of, cold_age, arrival=ARRIVAL)
        return FirstFound(rows, hot, cold)

    def _first_cold(self, query: LogQuery, as_of: datetime | str, at: Snapshot, newest: bool) -> Found:
        objects = self.objects(query, as_of, at)
        known = [(o.path, o.rows, o.min_us, o.max_us) for o in objects]
        # A directory without an index is one part with the bounds of its compaction.
        known += [(f"cold/compaction={c['compaction']}", c["rows"], micros(c["min_ts"]), micros(c["max_ts"]))
                  for c in self._cold_entries(at, query.start, query.end) if not c.get("indexed")]
        parts = sorted((Part(path, (high if newest else low,), rows) for path, rows, low, high in known), key=lambda p: p.best, reverse=newest)

        def read(some: list[Part]) -> DataFrame:
            return query.match(self._read_cold([p.name for p in some])).select(*LOG_COLUMNS, *ARRIVAL)

        def worst(found: DataFrame) -> tuple | None:
            us = F.unix_micros("timestamp")
            return (found.agg(F.min(us) if newest else F.max(us)).first()[0],)

        return first_rows(parts, read, pick_order("newest" if newest else "cold", ARRIVAL), query.tier_limit, worst, newest)

    def _first_hot(self, query: LogQuery, at: Snapshot) -> Found:
        commits = {key: token for key, token in self._commits().items() if not at.holds(*key)}
        files: dict[tuple[int, int], list[str]] = {}
        for path in self.folder.glob("hot/new/*.parquet"):
            run, batch, token = _batch_of(path)
            if commits.get((run, batch)) == token:
                files.setdefault((run, batch), []).append(path)
        segments = [Part("", (-1, -1), sum(s["rows"] for s in at.segments))] if at.segments else []
        # Batches have at least a row or no file; a first slice of one batch is the least that can fill the limit.
        parts = [*segments, *[Part(f"{run}-{batch}", (run, batch), query.tier_limit) for run, batch in sorted(files)]]

        def read(some: list[Part]) -> DataFrame:
            paths = [self.folder.child(path) for p in some if p.name for path in files[p.best]]
            new = self.spark.read.schema(HOT_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], HOT_SCHEMA)
            rows = new.select(*LOG_COLUMNS, *ARRIVAL)
            if not some[0].name:
                rows = rows.unionByName(self._segments(at.segments).filter(at.young()))
            return query.match(rows)

        def worst(found: DataFrame) -> tuple | None:
            return tuple(found.agg(F.max(F.struct("run", "batch_id"))).first()[0])

        return first_rows(parts, read, pick_order("hot", ARRIVAL), query.tier_limit, worst)

    def _hot_nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], HOT_SCHEMA).select(*LOG_COLUMNS, *ARRIVAL)

    def cold_nothing(self) -> DataFrame:
        return self.spark.createDataFrame([], COLD_SCHEMA)


def object_manifest(table: DataFrame) -> DataFrame:
    """Per data file: rows, first and last time as RFC 3339 to the second."""
    per_file = table.groupBy(F.col("_metadata.file_path").alias("object")).agg(
        F.count(F.lit(1)).alias("entry_count"), F.min("timestamp").alias("_min"), F.max("timestamp").alias("_max"))
    return per_file.select(
        "object", "entry_count", rfc3339_seconds(F.col("_min")).alias("start_time"),
        rfc3339_seconds(F.col("_max")).alias("end_time"))
