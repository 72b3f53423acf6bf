"""Streaming jobs run to the end of their input and read back."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.timefmt import as_micros
from emberlog.schema import RECORD_SCHEMA
from emberlog.session import set_meanwhile, shared_dir
from emberlog.sources.files import Folder
from emberlog.sources.record_log import RecordLog, log_records
from emberlog.sources.records import decode_records, good, publish_files, stream_partition, to_records
from emberlog.sources.tables import LogTables
from emberlog.streaming.alerts import stream_alerts
from emberlog.streaming.dedup import drop_redelivered, drop_redelivered_stream
from emberlog.streaming.delivery import delivery
from emberlog.streaming.ingest import ingest
from emberlog.streaming.metrics import counts_per_step, sliding_buckets
from emberlog.streaming.ordered import SEND_STATE_ONCE
from emberlog.streaming.rates import counter_slots, rates_of_slots
from emberlog.streaming.shedding import shed
from emberlog.streaming.sources import file_records
from emberlog.workload.alerts import (
    COOL, MAX_DEPTH, SPIKE, STATES_CTE, _hold_sql, depth_samples, or_minus_one,
)
from emberlog.workload.fixtures import (
    AS_OF, AS_OF_US, DECODED_CTE, LOGS_CTE, client_records, decoded_out, events, logs, table,
)
from emberlog.workload.ingest import REJECTED, _fnv_sql
from emberlog.workload.metrics import COUNTERS_CTE, HOUR, HOUR_US, counters
from emberlog.workload.registry import query


FILES = 4


#: Rows of one file, and of one slice of time, of the folders that streams read.
FILE_ROWS, SLICE_ROWS = 50_000, 10_000_000
#: Rows of one file of a folder cut by time, and of one slice for streams whose state holds every row of it: a join's, and samples in order.
TIMED_FILE_ROWS, JOIN_ROWS, ORDER_ROWS = 200_000, 2_000_000, 1_000_000
#: Most partitions of a stream's state, on a small cluster.
STATE_PARTS = 24


class _Parts:
    """Rows dealt into numbered parts, for a stream that takes one part per batch.

    The parts are set aside by one pass over the rows. Each of them then becomes the same number of files, written side by side, and one
    part is written after the other: a stream reads files in order of their time, so `files` of them are one part.
    """

    def __init__(self, rows: DataFrame, part: F.Column, path: str, file_rows: int = FILE_ROWS) -> None:
        self.spark, self.path, self.schema = rows.sparkSession, path, rows.schema
        self.aside = shared_dir(self.spark, "parts")
        rows.withColumn("_part", part.cast("int")).write.partitionBy("_part").parquet(self.aside)
        sizes = self._read().groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
        last, most = sizes.filter("_part IS NOT NULL").agg(F.max("_part"), F.max("n")).first()
        #: Parts up to the last one with rows, and files of each.
        self.parts, self.files = 1 + (last or 0), max(1, -(-(most or 0) // file_rows))

    def _read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(self.aside)

    def write(self, parts: range | None = None) -> int:
        """Write some parts (all), and tell how many files each of them has."""
        folder = Folder(self.spark, self.path)
        for i in range(self.parts) if parts is None else parts:
            due = len(folder.glob("*.parquet")) + self.files
            rows = self._read().filter(F.col("_part") == i).drop("_part")
            # A round-robin shuffle needs no key that some file would have too many rows of.
            (rows.coalesce(1) if self.files == 1 else rows.repartition(self.files)).write.mode("append").parquet(self.path)
            while len(folder.glob("*.parquet")) < due:  # tasks without rows write no file
                rows.limit(0).coalesce(1).write.mode("append").parquet(self.path)
        return self.files


def _in_files(rows: DataFrame, path: str, part: F.Column) -> int:
    """FILES parts, one after the other; returns the files of each."""
    return _Parts(rows, part, path).write(range(FILES))


def _records(spark: SparkSession, sf: str, path: str) -> _Parts:
    """The client records as parts of a folder of stream record files."""
    records = client_records(spark, sf).select(
        F.lit(None).cast("string").alias("key"), "value",
        (F.col("event_id") % 12).cast("int").alias("partition"), F.col("event_id").alias("offset"),
        F.timestamp_micros(F.lit(AS_OF_US)).alias("timestamp"))
    return _Parts(records, F.col("offset") % FILES, path)


def _ingested(spark: SparkSession, sf: str) -> LogTables:
    """The records streamed in with one part per batch, a stop in between, and the last batch before it handed over again."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    path, checkpoint = shared_dir(spark, "records"), shared_dir(spark, "checkpoint")
    records = _records(spark, sf, path)

    def run() -> None:
        ingest(file_records(spark, path, max_files=records.files), tables, checkpoint, available_now=True).awaitTermination()

    records.write(range(2))
    run()
    # As if the job had died between the write of batch 1 and its commit.
    Folder(spark, checkpoint).delete("commits/1")
    records.write(range(2, FILES))
    run()
    return tables


@query(f"""WITH {DECODED_CTE} SELECT event_id AS "offset", CAST(event_id % 12 AS INTEGER) AS partition, event_id % 4 AS batch_id, id, ts_us,
    source, level, message, label_k, trace_id FROM decoded""")
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Records streamed into the hot table over a restart and a replay; missing timestamps take the record's."""
    rows = _ingested(spark, sf).hot()
    return decoded_out(rows, "offset", "partition", "batch_id")


@query(f"""SELECT event_id AS "offset", CAST(event_id % 12 AS INTEGER) AS partition, 'unmarshal' AS error_type FROM events
    WHERE event_id % 50 IN {REJECTED}""")
def stream_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).quarantine().select("offset", "partition", "error_type")


@query(f"""SELECT event_id % 4 AS batch_id, count(*) AS input_rows, count(*) FILTER (event_id % 50 NOT IN {REJECTED}) AS accepted,
    count(*) FILTER (event_id % 50 IN {REJECTED}) AS rejected FROM events GROUP BY 1""")
def stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What the stream wrote down about its batches."""
    return _ingested(spark, sf).batches().select("batch_id", "input_rows", "accepted", "rejected")


@query(f"""WITH {LOGS_CTE} SELECT id, epoch_us("timestamp") AS ts_us, source, level, message, label_k,
    nullif(trace_id, '') AS trace_id, CASE WHEN trace_id <> '' THEN trace_id ELSE CAST({_fnv_sql('source')} AS VARCHAR) END AS key, true AS placed FROM logs""")
def publish_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Entries published as files per stream partition, read back and decoded; each lies in the partition of its key."""
    path = shared_dir(spark, "published")
    publish_files(to_records(logs(spark, sf)), path)
    records = spark.read.schema(RECORD_SCHEMA).parquet(path)
    entries = good(decode_records(records, AS_OF))
    placed = F.col("partition") == stream_partition(F.col("key"))
    return decoded_out(entries.withColumn("placed", placed).withColumn("trace_id", F.nullif("trace_id", F.lit(""))), "key", "placed")


def _logged(spark: SparkSession, sf: str) -> LogTables:
    """The client records appended to a record log in two steps and streamed in bounded batches, with a restart in between."""
    tables, path, checkpoint = LogTables(spark, shared_dir(spark, "tables")), shared_dir(spark, "log"), shared_dir(spark, "checkpoint")
    log = RecordLog(spark, path)
    records = client_records(spark, sf).select(
        F.lit(None).cast("string").alias("key"), "value", (F.col("event_id") % 12).cast("int").alias("partition"),
        F.timestamp_micros(F.lit(AS_OF_US)).alias("timestamp"), "event_id")
    total = records.count()
    for half in range(2):
        log.append(records.filter(F.col("event_id") % 2 == half))
        # A bound in proportion to the log: two batches for each half.
        job = ingest(log_records(spark, path, max(total // 4 + 1, 1), checkpoint), tables, checkpoint)
        try:
            job.processAllAvailable()
        finally:
            job.stop()
    return tables


@query(f"WITH {DECODED_CTE} SELECT CAST(event_id % 12 AS INTEGER) AS partition, id, ts_us, source, level, message, label_k, trace_id FROM decoded")
def stream_record_log(spark: SparkSession, sf: str) -> DataFrame:
    """Records streamed from the record log into the hot table."""
    return decoded_out(_logged(spark, sf).hot(), "partition")


@query("""SELECT CAST(event_id % 12 AS INTEGER) AS partition, count(*) AS records, 0::BIGINT AS first, count(*) - 1 AS last FROM events GROUP BY 1""")
def record_log_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Good and rejected records together have every offset of their partition once."""
    tables = _logged(spark, sf)
    stored = tables.hot().select("partition", "offset").unionByName(tables.quarantine().select("partition", "offset"))
    return stored.groupBy("partition").agg(
        F.count_distinct("offset").alias("records"), F.min("offset").alias("first"), F.max("offset").alias("last"))


def _redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """The logs, with one entry in ten delivered twice more and one id in seven missing."""
    rows = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp")).drop("labels")
    copies = F.when(F.col("ingest_seq") % 10 == 0, 3).otherwise(1)
    copied = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    nameless = F.col("ingest_seq") % 7 == 0
    return copied.withColumn("id", F.when(nameless, "").otherwise(F.col("id"))).withColumn(
        "partition", F.lit(0)).withColumn("offset", F.col("ingest_seq") * 3 + F.col("copy"))


REDELIVERED_SQL = """SELECT event_id AS ingest_seq, CASE WHEN event_id % 7 = 0 THEN ''
    ELSE CAST(event_id AS VARCHAR) END AS id,
    CASE WHEN event_id % 7 = 0 AND event_id % 10 = 0 THEN 3 ELSE 1 END::BIGINT AS rows FROM events"""


@query(REDELIVERED_SQL)
def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Streaming removal of redelivered copies over several batches; entries far behind the newest pass, rows without an
    id all stay."""
    source = shared_dir(spark, "redelivered")
    rows = _redelivered(spark, sf)
    # Copies of one id lie in different batches, and times of the month are mixed in each.
    files = _in_files(rows, source, (F.col("ingest_seq") + F.col("copy")) % FILES)
    target = shared_dir(spark, "deduplicated")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    unique = drop_redelivered_stream(stream)
    job = (unique.select("ingest_seq", "id").writeStream.format("parquet").option("path", target)
           .option("checkpointLocation", shared_dir(spark, "checkpoint")).trigger(availableNow=True).start())
    job.awaitTermination()
    written = spark.read.schema("ingest_seq bigint, id string").parquet(target)
    return written.groupBy("ingest_seq", "id").agg(F.count(F.lit(1)).alias("rows"))


@query(REDELIVERED_SQL)
def batch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    unique = drop_redelivered(_redelivered(spark, sf), ("offset",))
    return unique.groupBy("ingest_seq", "id").agg(F.count(F.lit(1)).alias("rows"))


def _weekly(rows: DataFrame, ts: str, path: str, arrival: F.Column | None = None, slice_rows: int = SLICE_ROWS, file_rows: int = TIMED_FILE_ROWS) -> int:
    """Parts by week of arrival (the time itself, if not given), and a last row far in the future, which lets everything
    before it finish. Rows without a time come first. Returns the files of a part.

    Weeks with more than `slice_rows` rows are cut into shorter spans, an hour at least, so that a batch, and the state that a join
    or a series holds until its end, does not grow with the table.
    """
    return _weekly_together([(rows, ts, path)], arrival, slice_rows, file_rows)[0]


def _weekly_together(tables: list[tuple[DataFrame, str, str]], arrival: F.Column | None = None, slice_rows: int = SLICE_ROWS,
                     file_rows: int = TIMED_FILE_ROWS) -> list[int]:
    """`_weekly` for several tables (rows, time, folder) cut at the same moments, so that streams that take one part of each per batch
    go through time side by side; `slice_rows` counts the rows of all."""
    hours = [F.floor(F.unix_micros(F.col(ts) if arrival is None else arrival) / HOUR_US) for _, ts, _ in tables]
    # One line per hour that occurs; rows without a time have none.
    counts = [{r.hour: r.n for r in rows.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n")).collect()}
              for (rows, _, _), hour in zip(tables, hours)]
    part_of = _cuts(sum(map(Counter, counts), Counter()), slice_rows)
    return [_dated(rows, ts, path, hour, part_of, n, file_rows) for (rows, ts, path), hour, n in zip(tables, hours, counts)]


def _cuts(counts: dict[int | None, int], slice_rows: int) -> dict[int | None, int]:
    """The part of each hour: whole weeks from the first day on, or as many hours of one as `slice_rows` rows allow, one at least."""
    timed = sorted(h for h in counts if h is not None)
    first = timed[0] // 24 * 24 if timed else 0
    part_of: dict[int | None, int] = {None: 0}
    part, week, filled = 0, 0, counts.get(None, 0)
    for hour in timed:
        own = (hour - first) // (7 * 24)
        if filled and (own != week or filled + counts[hour] > slice_rows):
            part, filled = part + 1, 0
        week, filled = own, filled + counts[hour]
        part_of[hour] = part
    return part_of


def _dated(rows: DataFrame, ts: str, path: str, hour: F.Column, part_of: dict[int | None, int], counts: dict[int | None, int],
           file_rows: int) -> int:
    """Write all parts at once, the same number of files each, and date the files in order of their parts, then the last row's."""
    spark, folder, sizes = rows.sparkSession, Folder(rows.sparkSession, path), Counter()
    for at, n in counts.items():
        sizes[part_of[at]] += n
    parts, files = 1 + max(part_of.values()), max(1, -(-max(sizes.values(), default=0) // file_rows))
    last = rows.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.col(ts) + F.expr("interval 60 days"))
    found = spark.createDataFrame([(h, p) for h, p in part_of.items() if h is not None], "_hour bigint, _part int")
    parted = rows.withColumn("_hour", hour).join(F.broadcast(found), "_hour", "left").withColumn("_part", F.coalesce("_part", F.lit(0)))
    if not folder.keeps_times():
        _Parts(parted.select(*rows.columns, "_part"), F.col("_part"), path, file_rows).write(range(parts))
        last.coalesce(1).write.mode("append").parquet(path)
        return files
    # The rows of a part are dealt by their number, which needs no key that some file would have too many rows of.
    file = (F.col("_part") * files + F.monotonically_increasing_id() % files).cast("int")
    parted.withColumn("_file", file).repartitionById(parts * files, "_file").select(*rows.columns).write.mode("append").parquet(path)
    written: list[list[str]] = [[] for _ in range(parts)]
    for name in folder.glob("*.parquet"):
        written[int(name.split("-")[1]) // files].append(name)
    if any(len(names) < files for names in written):  # tasks without rows write no file
        empty = shared_dir(spark, "empty")
        rows.limit(0).coalesce(1).write.parquet(empty)
        source = Folder(spark, empty)
        for part, names in enumerate(written):
            names += [folder.copy_of(source, source.glob("*.parquet")[0], f"part-{part}-{i}-empty.parquet") for i in range(files - len(names))]
    last.coalesce(1).write.mode("append").parquet(path)
    known = {name for names in written for name in names}
    folder.date([*written, [name for name in folder.glob("*.parquet") if name not in known]])
    return files


def _appended(spark: SparkSession, stream: DataFrame, schema: str) -> DataFrame:
    """What a stream in append mode writes until the end of its input."""
    target = shared_dir(spark, "finished")
    job = (stream.writeStream.format("parquet").option("path", target)
           .option("checkpointLocation", shared_dir(spark, "checkpoint")).trigger(availableNow=True))
    # Each partition is a state store, or four in a join, that every batch writes: a batch of bounded rows needs no more of them.
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(STATE_PARTS, 2 * spark.sparkContext.defaultParallelism))
    with set_meanwhile(spark, SEND_STATE_ONCE | {"spark.sql.shuffle.partitions": str(parts)}):
        running = job.start()
    running.awaitTermination()
    return spark.read.schema(schema).parquet(target)


def _finished(spark: SparkSession, rows: DataFrame, ts: str, transform, schema: str, arrival: F.Column | None = None,
              slice_rows: int = SLICE_ROWS) -> DataFrame:
    """An append-mode stream over rows in order of arrival, one week (or less, of many rows) per batch."""
    source = shared_dir(spark, "timed")
    files = _weekly(rows, ts, source, arrival, slice_rows)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    return _appended(spark, transform(stream), schema)


@query(f"""WITH {LOGS_CTE} SELECT epoch_us("timestamp") // {HOUR_US} * {HOUR_US} AS start_us, source, level,
    count(*) AS entries FROM logs GROUP BY 1, 2, 3""")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries per hour, source and level, counted by a stream that gives out each hour once it is over."""
    rows = logs(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp")).drop("labels")
    counted = _finished(spark, rows, "timestamp", lambda s: counts_per_step(s, step=HOUR),
                        "start timestamp, source string, level string, entries bigint")
    return counted.select(as_micros(F.col("start")).alias("start_us"), "source", "level", "entries")


@query(f"""WITH steps AS (SELECT epoch_us(ts) // {HOUR_US} AS step, event_type AS kind, value / 1000 AS seconds FROM events),
    spread AS (SELECT step - o.k AS start, kind, seconds FROM steps CROSS JOIN (SELECT unnest(range(3)) AS k) AS o),
    le AS (SELECT unnest([0.01, 0.05, 1e308]) AS le)
  SELECT start * {HOUR_US} AS start_us, kind, least(le, 1e300) AS le, count(*) FILTER (seconds <= le) AS count
  FROM spread CROSS JOIN le GROUP BY 1, 2, 3""")
def stream_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Latency buckets of three-hour windows that slide by an hour, from a stream."""
    rows = events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"),
                                    (F.col("value") / 1000).alias("seconds"))
    found = _finished(spark, rows, "ts", lambda s: sliding_buckets(s, "ts", "seconds", [0.01, 0.05], ["kind"], length=3 * HOUR, step=HOUR),
                      "window_start timestamp, kind string, le double, count bigint")
    return found.select(as_micros(F.col("window_start")).alias("start_us"), "kind", F.least("le", F.lit(1e300)).alias("le"), "count")


@query(f"WITH RECURSIVE {STATES_CTE} SELECT ingestor, seq, accept, active, coalesce(engaged_us, -1) AS engaged_us FROM states")
def stream_shedding(spark: SparkSession, sf: str) -> DataFrame:
    """Load-shedding state over a stream, carried from batch to batch."""
    source, target = shared_dir(spark, "depths"), shared_dir(spark, "shedding")
    rows = depth_samples(spark, sf)
    # A quarter of the samples per batch: the state is carried over three times.
    quarter = F.floor((F.col("seq") - rows.agg(F.min("seq")).first()[0]) * FILES / rows.count()).cast("int")
    files = _in_files(rows, source, F.least(quarter, F.lit(FILES - 1)))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)
    shed(stream, target, shared_dir(spark, "checkpoint"), MAX_DEPTH, COOL, available_now=True).awaitTermination()
    schema = "ingestor bigint, seq bigint, accept boolean, active boolean, engaged_us bigint"
    return spark.read.schema(schema).parquet(f"{target}/states").select(
        "ingestor", "seq", "accept", "active", or_minus_one("engaged_us"))


def _late(ts: str) -> F.Column:
    """Arrival up to eleven hours after the time: samples come out of order, some in a later batch."""
    return F.col(ts) + F.make_interval(hours=F.col("event_id") % 12)


GAP_US, HOLD_US = 2 * HOUR_US, 3 * HOUR_US
ALERT_SCHEMA = ("shard bigint, kind string, seq bigint, us bigint, active boolean, held_us bigint, firing boolean, "
                "alert string, severity string")


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The alert of `alert_hold_for` on a stream whose samples come up to eleven hours late."""
    samples = events(spark, sf).select("event_id", (F.col("user_id") % 12).alias("shard"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return _finished(spark, samples, "ts", lambda s: stream_alerts(s, SPIKE, ["shard"], "ts", "event_id", "value", max_gap=2 * HOUR),
                     ALERT_SCHEMA, _late("ts"), ORDER_ROWS)


HELD_SQL = f"""samples AS (SELECT event_id, user_id % 12 AS shard, ts, value FROM events),
    {_hold_sql('samples', 'shard', 'ts, event_id', 'value > 30', HOLD_US, GAP_US)}"""


@query(f"""WITH {HELD_SQL}
    SELECT event_id, shard, active, coalesce(held_us, -1) AS held_us, firing, 'SlowRequests' AS alert, 'warning' AS severity FROM judged""")
def stream_alert_hold_for(spark: SparkSession, sf: str) -> DataFrame:
    """Judged samples of a streamed alert."""
    return _alerts(spark, sf).filter("kind = 'sample'").select(
        F.col("seq").alias("event_id"), "shard", "active", or_minus_one("held_us"), "firing", "alert", "severity")


@query(f"""WITH {HELD_SQL}, ordered AS (
      SELECT *, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY shard ORDER BY ts, event_id) AS following FROM judged),
    runs AS (SELECT shard, island, min(us) + {HOLD_US} AS due, max(us) AS last, max_by(following, (us, event_id)) AS following,
               list(us) AS times FROM ordered WHERE active GROUP BY shard, island)
    SELECT shard, due AS us FROM runs
    WHERE NOT list_contains(times, due) AND (due < last OR due <= last + {GAP_US} AND (following IS NULL OR due < following))""")
def stream_alert_timers(spark: SparkSession, sf: str) -> DataFrame:
    """The moments at which a streamed alert fires between samples."""
    return _alerts(spark, sf).filter("kind = 'timer'").select("shard", "us")


@query(f"""WITH {COUNTERS_CTE} SELECT event_type, epoch_us(ts) // {HOUR_US} * {HOUR_US} - o.k * {HOUR_US}
      AS window_start, round(sum(increase), 4) AS increase, round(sum(increase) / 21600, 9) AS rate
  FROM grown CROSS JOIN (SELECT unnest(range(6)) AS k) AS o GROUP BY 1, 2""")
def stream_counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Counter increase per second over six hours, from the steps that a stream has finished; samples come late."""
    readings = counters(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    slots = _finished(spark, readings, "ts", lambda s: counter_slots(s, ["event_type"], "ts", "event_id", "value", step=HOUR),
                      "event_type string, slot bigint, increase double", _late("ts"), ORDER_ROWS)
    rates = rates_of_slots(slots, ["event_type"], 6 * HOUR, HOUR)
    return rates.select("event_type", "window_start", F.round("increase", 4).alias("increase"), F.round("rate", 9).alias("rate"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def stream_delivery_lost(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as sent entries and line items as stored ones, minutes later, on two streams: what is not stored in time."""
    def minute(key: str) -> F.Column:
        # Four weeks of sending, whatever the number of keys.
        return F.timestamp_seconds(F.lit(AS_OF_US // 1_000_000) + F.pmod(F.col(key) * 7919, F.lit(40_000)) * 60)

    late = F.make_interval(mins=F.col("l_orderkey") % 9)
    sent = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), minute("o_orderkey").alias("sent_at"))
    stored = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), (minute("l_orderkey") + late).alias("stored_at"))
    # Both streams end with an entry far in the future that is stored at once.
    tables = [(rows, ts, shared_dir(spark, ts)) for rows, ts in ((sent, "sent_at"), (stored, "stored_at"))]
    # Cut side by side: a stream that runs ahead of the other would be held in the join's state.
    files = _weekly_together(tables, slice_rows=JOIN_ROWS)
    streams = [spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", n).parquet(path) for (rows, _, path), n in zip(tables, files)]
    found = _appended(spark, delivery(*streams, within="10 minutes"), "id string, sent_at timestamp, stored_at timestamp")
    return found.filter("stored_at IS NULL").select("id")
