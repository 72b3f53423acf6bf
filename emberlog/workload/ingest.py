"""Decoding, quarantine, fill, routing and encoding of client records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.routing import fnv1a_32, routing_key
from emberlog.functions.timefmt import (
    as_micros, date_key, elapsed_millis, object_key, rfc3339_micros, rfc3339_seconds, unix_nanos,
)
from emberlog.operators.counters import error_counts, ingest_counts
from emberlog.schema import STREAM_PARTITIONS
from emberlog.sources.records import (
    acknowledgements, decode_records, explode_bodies, good, quarantined, rejected_bodies, stream_partition,
    to_records,
)
from emberlog.workload.fixtures import (
    AS_OF, AS_OF_US, BAD_TIME, DECODED_CTE, DECODED_SQL, LABEL_TYPE, LIST_BODY, LOGS_CTE, NO_TIME, NOT_JSON,
    NULL_BODY, NUMBER_ID, TRAILING, ZERO_TIME, client_records, decoded_out, entry_json, events, logs, table,
)
from emberlog.workload.registry import query

REJECTED = f"({NOT_JSON}, {NUMBER_ID}, {BAD_TIME}, {TRAILING}, {LIST_BODY}, {LABEL_TYPE})"
BODY_REJECTED = f"({NOT_JSON}, {NUMBER_ID}, {BAD_TIME}, {LIST_BODY}, {LABEL_TYPE})"


@query(f"WITH {DECODED_CTE} SELECT {DECODED_SQL} FROM decoded")
def ingest_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decoded_out(good(decode_records(client_records(spark, sf), AS_OF)), "event_id")


@query(f"""SELECT event_id, 'unmarshal' AS error_type, CASE event_id % 50
    WHEN {NOT_JSON} THEN 'not json ' || event_id
    WHEN {NUMBER_ID} THEN '{{"id":' || event_id || '}}'
    WHEN {BAD_TIME} THEN '{{"id":"' || event_id || '","timestamp":"yesterday"}}'
    WHEN {TRAILING} THEN '{{"id":"' || event_id || '"}} and more'
    WHEN {LIST_BODY} THEN '[{{"id":"' || event_id || '"}}]'
    ELSE '{{"id":"' || event_id || '","labels":{{"k":5}}}}' END AS raw
  FROM events WHERE event_id % 50 IN {REJECTED}""")
def ingest_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return quarantined(decode_records(client_records(spark, sf), AS_OF)).select("event_id", "error_type", "raw")


@query(f"""SELECT error_type, count(*) AS errors FROM (
    SELECT 'unmarshal' AS error_type FROM events WHERE event_id % 50 IN {REJECTED}
    UNION ALL SELECT 'decode' FROM events WHERE event_id % 50 IN {BODY_REJECTED}) GROUP BY error_type""")
def error_counts_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Stream records reject trailing text, request bodies do not."""
    records = client_records(spark, sf)
    stream = quarantined(decode_records(records, AS_OF))
    bodies = quarantined(decode_records(records, AS_OF, error_type="decode", allow_trailing=True))
    return error_counts(stream.unionByName(bodies))


@query(f"""WITH {DECODED_CTE} SELECT event_id, ts_us, ts_us = {AS_OF_US} AS filled FROM decoded
    ORDER BY event_id""")
def ingest_fill_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    """Missing and zero timestamps become the ingest time."""
    decoded = good(decode_records(client_records(spark, sf), AS_OF))
    us = as_micros(F.col("timestamp"))
    return decoded.select("event_id", us.alias("ts_us"), (us == AS_OF_US).alias("filled"))


BODY_ROWS = 50


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Request bodies of up to 50 entries; one body in ten has an element with a number for an id, and
    one in ten is a bare object."""
    body = F.floor(F.col("event_id") / BODY_ROWS).cast("long")
    bad = (body % 10 == 3) & (F.col("event_id") % BODY_ROWS == 7)
    element = F.when(bad, F.lit('{"id":7}')).when(
        F.col("event_id") % BODY_ROWS == 1,
        F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(entry_json())
    grouped = events(spark, sf).select(body.alias("body"), "event_id", element.alias("element")).groupBy("body").agg(
        F.sort_array(F.collect_list(F.struct("event_id", "element"))).alias("items"))
    joined = F.array_join(F.transform("items", lambda i: i["element"]), ",")
    return grouped.select(
        "body",
        F.when(F.col("body") % 10 == 5, F.get("items", F.lit(0))["element"])
        .otherwise(F.concat(F.lit("["), joined, F.lit("]"))).alias("value"))


BODIES_CTE = LOGS_CTE + f""",
elements AS (
  SELECT event_id // {BODY_ROWS} AS body, row_number() OVER (PARTITION BY event_id // {BODY_ROWS} ORDER BY event_id) - 1
           AS entry_index, l.id, CASE WHEN event_id % {BODY_ROWS} = 1 THEN {AS_OF_US} ELSE epoch_us(e.ts) END AS ts_us,
         CASE WHEN event_id % {BODY_ROWS} = 1 THEN NULL ELSE l.message END AS message,
         (event_id // {BODY_ROWS}) % 10 = 5 OR count(*) FILTER ((event_id // {BODY_ROWS}) % 10 = 3
           AND event_id % {BODY_ROWS} = 7) OVER (PARTITION BY event_id // {BODY_ROWS}) > 0 AS rejected
  FROM events e JOIN logs l ON l.ingest_seq = e.event_id
)"""


@query(f"WITH {BODIES_CTE} SELECT body, entry_index, id, ts_us, message FROM elements WHERE NOT rejected")
def ingest_batch_explode(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the accepted bodies; one bad element rejects its whole body."""
    return explode_bodies(bodies(spark, sf), AS_OF).select(
        "body", "entry_index", "id", as_micros(F.col("timestamp")).alias("ts_us"), "message")


@query(f"""WITH {BODIES_CTE} SELECT body, NOT bool_or(rejected) AS accepted,
    CASE WHEN bool_or(rejected) THEN 0 ELSE count(*) END AS ingested FROM elements GROUP BY body""")
def ingest_batch_ack(spark: SparkSession, sf: str) -> DataFrame:
    return acknowledgements(bodies(spark, sf), AS_OF)


@query(f"""WITH {BODIES_CTE} SELECT error_type, count(*) AS errors FROM (
    SELECT 'decode' AS error_type FROM elements WHERE rejected GROUP BY body) GROUP BY error_type""")
def ingest_batch_errors(spark: SparkSession, sf: str) -> DataFrame:
    return error_counts(rejected_bodies(bodies(spark, sf), AS_OF))


@query(f"WITH {LOGS_CTE} SELECT source, level, count(*) AS entries FROM logs GROUP BY source, level")
def ingest_counts_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return ingest_counts(logs(spark, sf))


# 32-bit FNV-1a over the bytes of an ASCII column.
def _fnv_sql(column: str) -> str:
    return f"""list_reduce(list_prepend(2166136261::BIGINT, list_transform(
        range(1, strlen({column}) + 1), lambda i: ascii(substr({column}, i::INT, 1))::BIGINT)),
        lambda h, b: (xor(h, b) * 16777619) % 4294967296)"""


@query(f"""WITH {LOGS_CTE} SELECT id, CASE WHEN trace_id <> '' THEN trace_id
    ELSE CAST({_fnv_sql('source')} AS VARCHAR) END AS key FROM logs""")
def routing_key_of_entries(spark: SparkSession, sf: str) -> DataFrame:
    return logs(spark, sf).select("id", routing_key(F.col("source"), F.col("trace_id")).alias("key"))


@query(f"SELECT p_partkey, {_fnv_sql('p_name')} AS hash FROM part")
def source_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", fnv1a_32(F.col("p_name")).alias("hash"))


@query(f"""WITH {LOGS_CTE} SELECT CASE WHEN trace_id <> '' THEN trace_id
    ELSE CAST({_fnv_sql('source')} AS VARCHAR) END AS key, count(*) AS records, 1::BIGINT AS partitions,
    true AS in_range FROM logs GROUP BY ALL""")
def routing_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Every key lands in exactly one stream partition."""
    records = to_records(logs(spark, sf)).select("key")
    placed = records.withColumn("partition", stream_partition(F.col("key"))).groupBy("key", "partition").agg(
        F.count(F.lit(1)).alias("records"))
    return placed.groupBy("key").agg(
        F.sum("records").alias("records"), F.count("partition").alias("partitions"),
        (F.max("partition") < STREAM_PARTITIONS).alias("in_range"))


RFC_SQL = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN ''
    ELSE rtrim(strftime(ts, '.%f'), '0') END || 'Z'"""


@query(f"""WITH {LOGS_CTE} SELECT l.id,
    '{{"id":"' || l.id || '","timestamp":"' || {RFC_SQL} || '","source":"' || source || '","level":"' || level
    || '","message":"' || message || '","labels":{{"k":"' || label_k || '"}}'
    || CASE WHEN trace_id = '' THEN '' ELSE ',"trace_id":"' || trace_id || '"' END || '}}' AS value
  FROM logs l JOIN events ON event_id = ingest_seq""")
def encode_records(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded entries; empty optional fields are left out."""
    rows = logs(spark, sf)
    encoded = to_records(rows).select("value")
    return encoded.select(F.get_json_object("value", "$.id").alias("id"), "value")


@query(f"""SELECT event_id, strftime(ts, '%Y/%m/%d') AS date_key, epoch_us(ts) * 1000 AS nanos,
    'logs/' || strftime(ts, '%Y/%m/%d') || '/' || (epoch_us(ts) * 1000) || '.json.gz' AS object,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, {RFC_SQL} AS micros,
    CAST(floor(({AS_OF_US} - epoch_us(ts)) / 1000.0) AS DOUBLE) AS age_ms FROM events""")
def time_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Date key, object key, RFC 3339 texts and age of every entry."""
    ts = F.col("ts").cast("timestamp")
    return events(spark, sf).select(
        "event_id", date_key(ts).alias("date_key"), unix_nanos(ts).alias("nanos"), object_key(ts).alias("object"),
        rfc3339_seconds(ts).alias("seconds"), rfc3339_micros(ts).alias("micros"),
        elapsed_millis(ts, F.timestamp_micros(F.lit(AS_OF_US))).alias("age_ms"))
