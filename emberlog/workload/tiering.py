"""Age splits, compaction, archives and the tables on disk."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros, utc
from emberlog.operators.counters import acknowledged, storage_by_tier, tier_counts
from emberlog.operators.retention import drain, evict, lateness
from emberlog.plans.query import LogQuery
from emberlog.plans.search import with_position
from emberlog.schema import ARRIVAL, LOG_COLUMNS
from emberlog.session import settled, shared_dir
from emberlog.sources.archive import chunks, read_archive, skipped_objects, write_archive
from emberlog.sources.files import Folder
from emberlog.sources.tables import LogTables, object_manifest
from emberlog.workload.fixtures import (
    AS_OF, AS_OF_US, CUTOFF, LOGS_CTE, OUT_SQL, RETENTION_CUTOFF, logs, out,
)
from emberlog.workload.registry import query
from emberlog.workload.search import TIERED, TIERED_SQL


@query(f"""WITH {LOGS_CTE} SELECT id, CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' THEN 'drained' ELSE 'kept' END
    AS side FROM logs""")
def drain_split(spark: SparkSession, sf: str) -> DataFrame:
    drained, kept = drain(logs(spark, sf), AS_OF)
    return (drained.select("id", F.lit("drained").alias("side"))
            .unionByName(kept.select("id", F.lit("kept").alias("side"))))


@query(f"""WITH {LOGS_CTE} SELECT id, CASE WHEN "timestamp" < TIMESTAMP '{RETENTION_CUTOFF}' THEN 'evicted'
    ELSE 'kept' END AS side FROM logs""")
def evict_split(spark: SparkSession, sf: str) -> DataFrame:
    kept, evicted = evict(logs(spark, sf), AS_OF)
    return (kept.select("id", F.lit("kept").alias("side"))
            .unionByName(evicted.select("id", F.lit("evicted").alias("side"))))


@query(f"""WITH {LOGS_CTE}, late AS (SELECT id, {AS_OF_US} - epoch_us("timestamp") AS late_us FROM logs)
  SELECT id, late_us, CASE WHEN late_us > 86400000000 THEN 'expired' WHEN late_us > 21600000000 THEN 'late'
    ELSE 'on_time' END AS lateness FROM late""")
def lateness_class(spark: SparkSession, sf: str) -> DataFrame:
    return lateness(logs(spark, sf), AS_OF).select("id", "late_us", "lateness")


@query(f"""WITH {LOGS_CTE} SELECT CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' THEN 'cold' ELSE 'hot' END AS tier,
    count(*) AS entries FROM logs GROUP BY 1""")
def entries_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    cold, hot = drain(logs(spark, sf), AS_OF)
    return tier_counts(hot.select(F.lit("hot").alias("tier")).unionByName(cold.select(F.lit("cold").alias("tier"))))


# Small enough that the smallest tables make several objects and several blocks of ranks.
CHUNK = 300
ARCHIVED_CTE = LOGS_CTE + f""",
aged AS (SELECT *, row_number() OVER (ORDER BY ingest_seq) - 1 AS place FROM logs
         WHERE "timestamp" < TIMESTAMP '{CUTOFF}')"""


@query(f"""WITH {ARCHIVED_CTE}, c AS (SELECT place // {CHUNK} AS chunk, min("timestamp") AS first,
      max("timestamp") AS last, count(*) AS entry_count FROM aged GROUP BY 1)
  SELECT chunk, entry_count, 'logs/' || strftime(first, '%Y/%m/%d') || '/' || (epoch_us(first) * 1000) || '.json.gz'
    AS object, epoch_us(first) AS start_us, epoch_us(last) AS end_us FROM c""")
def archive_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The archive objects of a compaction: runs of rows in arrival order."""
    cold, _ = drain(logs(spark, sf), AS_OF)
    return chunks(cold, chunk_rows=CHUNK, block=CHUNK * 3).select(
        "chunk", "entry_count", "object", as_micros(F.col("start_time")).alias("start_us"),
        as_micros(F.col("end_time")).alias("end_us"))


@query(f"""WITH {ARCHIVED_CTE} SELECT id, epoch_us("timestamp") AS ts_us, source, level, message, label_k,
    nullif(trace_id, '') AS trace_id FROM aged""")
def archive_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Entries written as gzip JSON arrays and read back."""
    cold, _ = drain(logs(spark, sf), AS_OF)
    path = shared_dir(spark, "archive")
    write_archive(cold, path)
    back = read_archive(spark, path)
    return back.select(
        "id", as_micros(F.col("timestamp")).alias("ts_us"), "source", "level", "message",
        F.col("labels")["k"].alias("label_k"), "trace_id")


@query(f"""WITH {ARCHIVED_CTE} SELECT place // {CHUNK} AS chunk, count(*) AS entries, true AS ascending FROM aged GROUP BY 1""")
def archive_order(spark: SparkSession, sf: str) -> DataFrame:
    """Every object holds its entries in ascending time order."""
    cold, _ = drain(logs(spark, sf), AS_OF)
    stamps = F.from_json("value", "array<struct<timestamp:string>>")["timestamp"]
    times = F.transform(stamps, lambda t: F.unix_micros(t.cast("timestamp")))
    return chunks(cold, chunk_rows=CHUNK).select(
        "chunk", F.size(times).cast("long").alias("entries"), (times == F.array_sort(times)).alias("ascending"))


@query(f"""WITH {ARCHIVED_CTE} SELECT count(DISTINCT place // {CHUNK}) + 3 AS objects, 3::BIGINT AS skipped, count(*) AS entries FROM aged""")
def archive_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Objects of an archive, and how many of them cannot be read: no gzip, no array, an element of the wrong type."""
    cold, _ = drain(logs(spark, sf), AS_OF)
    path = shared_dir(spark, "archive")
    write_archive(cold, path, chunk_rows=CHUNK)
    bad = Folder(spark, path)
    bad.publish("dt=2024-01-02/torn.txt.gz", "not gzip")
    texts = spark.createDataFrame([('{"id": "1"}',), ('[{"id": "1"}, {"id": 2}]',)], "value string")
    (texts.coalesce(1).write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 1).text(f"{path}/dt=2024-01-02"))
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select(F.lit(0).alias("skipped")))
    skipped = skipped_objects(spark, path).select(F.lit(1).alias("skipped"))
    read = read_archive(spark, path).select(F.lit(2).alias("skipped"))
    return listed.unionByName(skipped).unionByName(read).agg(
        F.count_if(F.col("skipped") == 0).alias("objects"), F.count_if(F.col("skipped") == 1).alias("skipped"),
        F.count_if(F.col("skipped") == 2).alias("entries"))


def _stored(spark: SparkSession, sf: str, as_of: str | None = None, files: int | None = None, rows_per_file: int = 0,
            cluster: tuple[str, ...] = ()) -> LogTables:
    """Tables that hold the logs in three batches, compacted twice, with late rows in between.

    The first two batches are compacted; the third arrives after that, so its aged rows are still hot.
    """
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    part = F.pmod(F.col("id").cast("long"), F.lit(3))
    offsets = rows.withColumn("offset", F.col("id").cast("long"))

    def append(n: int) -> None:
        batch = offsets.filter(part == n)
        # Only the write is left to that many tasks.
        tables.append(batch.repartition(files) if files else batch, n)

    append(0)
    tables.compact(utc(AS_OF) - timedelta(days=10), files=files, rows_per_file=rows_per_file, cluster=cluster)
    append(1)
    tables.compact(as_of or AS_OF, files=files, rows_per_file=rows_per_file, cluster=cluster)
    append(2)
    return tables


@query(f"""WITH {LOGS_CTE} SELECT id, epoch_us("timestamp") AS ts_us, message,
    CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' AND ingest_seq % 3 < 2 THEN 'cold' ELSE 'hot' END AS tier
  FROM logs""")
def compact_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """After two compactions every row is visible in exactly one tier."""
    tables = _stored(spark, sf)
    columns = ["id", as_micros(F.col("timestamp")).alias("ts_us"), "message"]
    return (tables.hot().select(*columns, F.lit("hot").alias("tier"))
            .unionByName(tables.cold().select(*columns, F.lit("cold").alias("tier"))))


@query(f"""WITH {LOGS_CTE}, found AS (
    SELECT *, ingest_seq % 3 AS batch, CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' AND ingest_seq % 3 < 2 THEN 1 ELSE 0 END
      AS tier_rank FROM logs WHERE {TIERED_SQL}),
  picked AS (
    SELECT * FROM (SELECT * FROM found WHERE tier_rank = 0 ORDER BY batch, ingest_seq LIMIT 50)
    UNION ALL SELECT * FROM (SELECT * FROM found WHERE tier_rank = 1 ORDER BY "timestamp" LIMIT 50)),
  placed AS (SELECT *, row_number() OVER (ORDER BY tier_rank, CASE WHEN tier_rank = 0 THEN -epoch_us("timestamp") END,
      "timestamp") AS position FROM picked)
  SELECT {OUT_SQL}, CASE tier_rank WHEN 0 THEN 'hot' ELSE 'cold' END AS tier, position FROM placed
  WHERE position <= 50""")
def compact_search(spark: SparkSession, sf: str) -> DataFrame:
    """A tiered search over the tables on disk; aged rows that are still hot are found in hot."""
    tables = _stored(spark, sf)
    found = with_position(tables.search(TIERED, AS_OF), arrival=ARRIVAL)
    return out(found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "tier", "position")


@query(f"""WITH {LOGS_CTE}, moved AS (SELECT "timestamp" AS ts,
      CASE WHEN ingest_seq % 3 = 0 AND "timestamp" < TIMESTAMP '2024-01-19 18:00:00' THEN 0 ELSE 1 END::BIGINT AS n
    FROM logs WHERE ingest_seq % 3 < 2 AND "timestamp" < TIMESTAMP '{CUTOFF}')
  SELECT n, count(*) AS rows, epoch_us(min(ts)) AS min_us, epoch_us(max(ts)) AS max_us FROM moved GROUP BY n""")
def compact_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One manifest row per compaction."""
    return _stored(spark, sf).manifest().select(
        "n", "rows", as_micros(F.col("min_ts")).alias("min_us"), as_micros(F.col("max_ts")).alias("max_us"))


@query(f"""WITH {LOGS_CTE} SELECT strftime("timestamp", '%Y-%m-%d') AS day, count(*) AS entry_count,
    strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS start_time,
    strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%SZ') AS end_time
  FROM logs WHERE ingest_seq % 3 < 2 AND "timestamp" < TIMESTAMP '{CUTOFF}' GROUP BY 1""")
def archive_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Per-object manifest of the cold table, summed up per day."""
    objects = object_manifest(_stored(spark, sf).cold())
    day = F.regexp_extract("object", r"dt=(\d{4}-\d{2}-\d{2})", 1)
    return objects.groupBy(day.alias("day")).agg(
        F.sum("entry_count").alias("entry_count"), F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"))


@query(f"""WITH {LOGS_CTE} SELECT ingest_seq % 3 AS batch_id, count(*) AS ingested FROM logs GROUP BY 1""")
def stored_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Entries per stored batch."""
    return acknowledged(_stored(spark, sf).stored(), "batch_id")


@query(f"""WITH {LOGS_CTE}, aged AS (SELECT strftime("timestamp", '%Y-%m-%d') AS dt,
      CASE WHEN ingest_seq % 3 = 0 AND "timestamp" < TIMESTAMP '2024-01-19 18:00:00' THEN 0 ELSE 1 END AS n
    FROM logs WHERE ingest_seq % 3 < 2 AND "timestamp" < TIMESTAMP '{CUTOFF}'),
  objects AS (SELECT ceil(count(*) / 50) AS files FROM aged GROUP BY n, dt)
  SELECT 'cold' AS tier, CAST(sum(files) AS BIGINT) AS objects, true AS filled FROM objects
  UNION ALL SELECT 'new', 3, true""")
def storage_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Objects per tier, and whether they hold bytes: objects of at most 50 rows in cold, one file per batch in hot."""
    tables = _stored(spark, sf, files=1, rows_per_file=50)
    usage = (storage_by_tier(spark, tables.folder.child("cold"), "cold")
             .unionByName(storage_by_tier(spark, tables.folder.child("hot/new"), "new")))
    return usage.select("tier", "objects", (F.col("bytes") > F.col("objects")).alias("filled"))


@query(f"""WITH {LOGS_CTE} SELECT id, CASE WHEN ingest_seq % 2 = 0 AND "timestamp" < TIMESTAMP '{CUTOFF}' THEN 'cold' ELSE 'hot' END AS tier
  FROM logs""")
def compact_two_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A run that writes smaller batch numbers after a compaction of another loses nothing."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    even = F.col("id").cast("long") % 2 == 0
    tables.append(rows.filter(even), 5, run=1)
    tables.compact(AS_OF)
    tables.append(rows.filter(~even), 2, run=0)
    return (tables.hot().select("id", F.lit("hot").alias("tier"))
            .unionByName(tables.cold().select("id", F.lit("cold").alias("tier"))))


@query(f"""WITH {LOGS_CTE} SELECT id FROM logs WHERE "timestamp" >= TIMESTAMP '{RETENTION_CUTOFF}'""")
def evicted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """After an eviction, old rows are gone from a batch that also holds young ones."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    tables.append(rows, 0)
    tables.evict(AS_OF)
    return tables.stored().select("id")


@query(f"""WITH {LOGS_CTE} SELECT id FROM logs WHERE ingest_seq % 2 = 0 OR "timestamp" >= TIMESTAMP '{RETENTION_CUTOFF}'""")
def evicted_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """An eviction after a compaction discards late rows past retention only, not those behind the compaction's cutoff."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    even = F.col("id").cast("long") % 2 == 0
    tables.append(rows.filter(even), 0)
    tables.compact(AS_OF)
    tables.append(rows.filter(~even), 1)
    tables.evict(AS_OF)
    return tables.stored().select("id")


@query(f"""WITH {LOGS_CTE} SELECT {OUT_SQL} FROM logs
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-08 06:00:00' AND TIMESTAMP '2024-01-11 06:00:00'
      AND ingest_seq % 3 < 2""")
def cold_date_pruning(spark: SparkSession, sf: str) -> DataFrame:
    """A range over the cold table reads only the dates it covers."""
    request = LogQuery(start="2024-01-08 06:00:00", end="2024-01-11 06:00:00")
    cold = _stored(spark, sf).cold(request.start, request.end)
    return out(request.match(cold).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")))


# Rows per object of the queries below: the smallest tables have several objects too.
OBJECT_ROWS = 200
MONTH = ("2024-01-01 00:00:00", "2024-01-29 12:00:00")
FIRST_SQL = f"""found AS (
    SELECT *, ingest_seq % 3 AS batch, CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' AND ingest_seq % 3 < 2 THEN 1 ELSE 0 END AS tier_rank
    FROM logs WHERE "timestamp" BETWEEN TIMESTAMP '{MONTH[0]}' AND TIMESTAMP '{MONTH[1]}' AND level = 'ERROR')"""


@query(f"""WITH {LOGS_CTE}, {FIRST_SQL},
  picked AS (
    SELECT * FROM (SELECT * FROM found WHERE tier_rank = 0 ORDER BY batch, ingest_seq LIMIT 20)
    UNION ALL SELECT * FROM (SELECT * FROM found WHERE tier_rank = 1 ORDER BY "timestamp", batch, ingest_seq LIMIT 20)),
  placed AS (SELECT *, row_number() OVER (ORDER BY tier_rank, CASE WHEN tier_rank = 0 THEN -epoch_us("timestamp") END,
      "timestamp", batch, ingest_seq) AS position FROM picked)
  SELECT {OUT_SQL}, CASE tier_rank WHEN 0 THEN 'hot' ELSE 'cold' END AS tier, position, true AS stopped FROM placed WHERE position <= 20""")
def search_stops_early(spark: SparkSession, sf: str) -> DataFrame:
    """A limited search over a month that reads the cold objects in order of time, and not all of them."""
    tables = _stored(spark, sf, rows_per_file=OBJECT_ROWS)
    request = LogQuery(start=MONTH[0], end=MONTH[1], level="ERROR", limit=20)
    found = tables.search_first(request, AS_OF)
    rows = with_position(found.rows, arrival=ARRIVAL).withColumn("stopped", F.lit(found.cold.parts_read < found.cold.parts))
    return out(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "tier", "position", "stopped")


@query(f"""WITH {LOGS_CTE}, {FIRST_SQL}, placed AS (
    SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id) AS position FROM found)
  SELECT {OUT_SQL}, CASE tier_rank WHEN 0 THEN 'hot' ELSE 'cold' END AS tier, position, true AS stopped FROM placed WHERE position <= 20""")
def search_newest_stops_early(spark: SparkSession, sf: str) -> DataFrame:
    """The newest matches of a month: cold objects are read from the last one on."""
    tables = _stored(spark, sf, rows_per_file=OBJECT_ROWS)
    request = LogQuery(start=MONTH[0], end=MONTH[1], level="ERROR", limit=20, order="newest")
    found = tables.search_first(request, AS_OF)
    rows = with_position(found.rows, "newest", arrival=ARRIVAL).withColumn("stopped", F.lit(found.cold.parts_read < found.cold.parts))
    return out(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "tier", "position", "stopped")


TEXT = "sage 77"


@query(f"""WITH {LOGS_CTE} SELECT {OUT_SQL}, CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' AND ingest_seq % 3 < 2 THEN 'cold' ELSE 'hot' END AS tier, true AS skipped
  FROM logs WHERE contains(message, '{TEXT}')""")
def search_skips_objects(spark: SparkSession, sf: str) -> DataFrame:
    """A text search over stored tables that reads only the objects whose trigrams admit the text."""
    tables = _stored(spark, sf, rows_per_file=OBJECT_ROWS)
    request = LogQuery(start="2024-01-01", end=AS_OF, text=TEXT)
    every = tables.objects(LogQuery(start="2024-01-01", end=AS_OF), AS_OF)
    skipped = len(tables.objects(request, AS_OF)) < len(every)
    cold = request.match(tables.cold(request.start, request.end, query=request)).withColumn("tier", F.lit("cold"))
    hot = request.match(tables.hot()).withColumn("tier", F.lit("hot"))
    columns = [*LOG_COLUMNS, "tier"]
    rows = cold.select(columns).unionByName(hot.select(columns)).withColumn("skipped", F.lit(skipped))
    return out(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "tier", "skipped")


@query(f"""WITH {LOGS_CTE} SELECT {OUT_SQL}, true AS in_proportion FROM logs
  WHERE source = 'signup' AND level = 'WARN' AND "timestamp" < TIMESTAMP '{CUTOFF}' AND ingest_seq % 3 < 2""")
def search_clustered(spark: SparkSession, sf: str) -> DataFrame:
    """One source and level of a cold table clustered by source, level and time: the bytes read follow the source's share."""
    # Some ten objects a day: a day is the least that clustering can order.
    tables = _stored(spark, sf, rows_per_file=max(1, logs(spark, sf).count() // 450), cluster=("source", "level"))
    request = LogQuery(start="2024-01-01", end=AS_OF, source="signup", level="WARN")
    every = sum(o.bytes for o in tables.objects(LogQuery(start="2024-01-01", end=AS_OF), AS_OF))
    read = sum(o.bytes for o in tables.objects(request, AS_OF))
    rows = request.match(tables.cold(request.start, request.end, query=request))
    share = rows.count() / max(tables.cold().count(), 1)
    return out(rows.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).withColumn("in_proportion", F.lit(read <= 2.5 * share * every)),
               "in_proportion")


@query(f"""WITH {LOGS_CTE} SELECT id, 'torn' AS seen FROM logs WHERE ingest_seq % 2 = 0 UNION ALL SELECT id, 'replayed' FROM logs""")
def torn_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A batch whose job dies between moving its files and its commit is not there at all, and its replay is there once."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    even = F.col("id").cast("long") % 2 == 0
    tables.append(rows.filter(even), 0)
    publish = tables.folder.publish
    tables.folder.publish = lambda *_: False
    try:
        tables.append(rows.filter(~even), 1)
    except RuntimeError:
        tables.folder.publish = publish
    torn = settled(tables.hot().select("id", F.lit("torn").alias("seen")), "torn")
    tables.append(rows.filter(~even), 1)
    return torn.unionByName(tables.hot().select("id", F.lit("replayed").alias("seen")))


@query(f"""WITH {LOGS_CTE} SELECT {OUT_SQL}, CASE WHEN "timestamp" < TIMESTAMP '{CUTOFF}' THEN 'cold' ELSE 'hot' END AS tier, true AS few FROM logs""")
def merged_cold(spark: SparkSession, sf: str) -> DataFrame:
    """Eight compactions of a month, half a week each, merged by size: no row is lost or doubled, and few directories are left."""
    tables = LogTables(spark, shared_dir(spark, "tables"))
    rows = logs(spark, sf).drop("ingest_seq").withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    tables.append(rows, 0)
    for k in range(7, -1, -1):
        tables.compact(utc(AS_OF) - k * timedelta(days=3.5))
    before = len(tables.snapshot().cold)
    tables.merge_cold(fanout=2)
    tables.clean()
    few = len(tables.snapshot().cold) < before
    columns = [*LOG_COLUMNS, "tier", "few"]
    cold, hot = (t.withColumn("tier", F.lit(name)).withColumn("few", F.lit(few)).select(columns)
                 for t, name in ((tables.cold(), "cold"), (tables.hot(), "hot")))
    return out(cold.unionByName(hot).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")), "tier", "few")
