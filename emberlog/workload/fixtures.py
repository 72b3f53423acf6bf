"""Log-shaped views over the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timefmt import as_micros, rfc3339_micros

AS_OF = "2024-01-30 00:00:00"
AS_OF_US = 1_706_572_800_000_000
CUTOFF = "2024-01-29 18:00:00"
RETENTION_CUTOFF = "2024-01-29 00:00:00"

LOG_OUT = ["id", "timestamp", "source", "level", "message", "label_k", "trace_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def level_of() -> F.Column:
    kind = F.col("event_type")
    severe = F.when(F.col("event_id") % 10 == 0, "FATAL").otherwise("ERROR")
    return (F.when(kind == "error", severe).when(kind == "signup", "WARN").when(kind == "view", "DEBUG")
            .otherwise("INFO"))


def trace_of() -> F.Column:
    return F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("trace-"), F.col("user_id").cast("string")))


def message_of() -> F.Column:
    return F.concat(F.lit("message "), F.col("event_id").cast("string"), F.lit(" from "), F.col("event_type"))


def logs(spark: SparkSession, sf: str) -> DataFrame:
    """Entries made from the events, one each; timestamps stay without zone so filters reach the scan."""
    return events(spark, sf).select(
        F.col("event_id").cast("string").alias("id"),
        F.col("ts").alias("timestamp"),
        F.col("event_type").alias("source"),
        level_of().alias("level"),
        message_of().alias("message"),
        F.from_json("props", "map<string,string>").alias("labels"),
        trace_of().alias("trace_id"),
        F.lit(None).cast("string").alias("span_id"),
        F.col("event_id").alias("ingest_seq"),
    )


LOGS_CTE = """
logs AS (
  SELECT CAST(event_id AS VARCHAR) AS id, ts AS "timestamp", event_type AS source,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'FATAL' ELSE 'ERROR' END
              WHEN event_type = 'signup' THEN 'WARN' WHEN event_type = 'view' THEN 'DEBUG'
              ELSE 'INFO' END AS level,
         'message ' || CAST(event_id AS VARCHAR) || ' from ' || event_type AS message,
         json_extract_string(props, '$.k') AS label_k,
         CASE WHEN user_id % 5 = 0 THEN '' ELSE 'trace-' || CAST(user_id AS VARCHAR) END AS trace_id,
         event_id AS ingest_seq
  FROM events
)"""

OUT_SQL = 'id, "timestamp", source, level, message, label_k, trace_id'


def out(df: DataFrame, *extra: str) -> DataFrame:
    """The entry columns in comparable form: the one label as a column instead of the map."""
    return df.select(
        *[F.col("labels")["k"].alias(c) if c == "label_k" else F.col(c) for c in LOG_OUT], *extra)


def rfc3339(ts: str) -> F.Column:
    return rfc3339_micros(F.col(ts).cast("timestamp"))


def json_text(value: F.Column) -> F.Column:
    """A quoted JSON string; the fixture's texts need no escapes."""
    return F.concat(F.lit('"'), value, F.lit('"'))


def entry_json() -> F.Column:
    """JSON text of an event's entry, as a client would send it."""
    return F.concat(
        F.lit('{"id":'), json_text(F.col("event_id").cast("string")),
        F.lit(',"timestamp":'), json_text(rfc3339("ts")),
        F.lit(',"source":'), json_text(F.col("event_type")),
        F.lit(',"level":'), json_text(level_of()),
        F.lit(',"message":'), json_text(message_of()),
        F.lit(',"labels":{"k":"'), F.get_json_object("props", "$.k"), F.lit('"}'),
        F.lit(',"trace_id":'), json_text(trace_of()), F.lit("}"))


# Kinds of client record, by event_id % 50; all others are whole and well-formed.
NOT_JSON, NUMBER_ID, BAD_TIME, NO_TIME, ZERO_TIME, EXTRA_FIELD, TRAILING, NULL_BODY, LIST_BODY, LABEL_TYPE = range(10)


def client_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as clients send them, (event_id, value), with one malformed or unusual kind in five."""
    kind = F.col("event_id") % 50
    ident = F.concat(F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('"'))
    value = (
        F.when(kind == NOT_JSON, F.concat(F.lit("not json "), F.col("event_id").cast("string")))
        .when(kind == NUMBER_ID, F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")))
        .when(kind == BAD_TIME, F.concat(ident, F.lit(',"timestamp":"yesterday"}')))
        .when(kind == NO_TIME, F.concat(ident, F.lit(',"source":'), json_text(F.col("event_type")), F.lit("}")))
        .when(kind == ZERO_TIME, F.concat(ident, F.lit(',"timestamp":"0001-01-01T00:00:00Z"}')))
        .when(kind == EXTRA_FIELD, F.concat(
            ident, F.lit(',"extra":[1,{"a":null}],"timestamp":'), json_text(rfc3339("ts")), F.lit("}")))
        .when(kind == TRAILING, F.concat(ident, F.lit("} and more")))
        .when(kind == NULL_BODY, F.lit("null"))
        .when(kind == LIST_BODY, F.concat(F.lit("["), ident, F.lit("}]")))
        .when(kind == LABEL_TYPE, F.concat(ident, F.lit(',"labels":{"k":5}}')))
        .otherwise(entry_json()))
    return events(spark, sf).select("event_id", value.alias("value"))


# Rows that the stream decoder accepts, as columns (event_id, id, ts_us, source, level, message, label_k, trace_id).
DECODED_CTE = LOGS_CTE + f""",
decoded AS (
  SELECT e.event_id, e.event_id % 50 AS kind,
         CASE WHEN e.event_id % 50 = {NULL_BODY} THEN NULL ELSE l.id END AS id,
         CASE WHEN e.event_id % 50 IN ({NO_TIME}, {ZERO_TIME}, {NULL_BODY}) THEN {AS_OF_US}
              ELSE epoch_us(e.ts) END AS ts_us,
         CASE WHEN e.event_id % 50 IN ({ZERO_TIME}, {EXTRA_FIELD}, {NULL_BODY}) THEN NULL ELSE l.source END AS source,
         CASE WHEN e.event_id % 50 < 10 THEN NULL ELSE l.level END AS level,
         CASE WHEN e.event_id % 50 < 10 THEN NULL ELSE l.message END AS message,
         CASE WHEN e.event_id % 50 < 10 THEN NULL ELSE l.label_k END AS label_k,
         CASE WHEN e.event_id % 50 < 10 THEN NULL ELSE l.trace_id END AS trace_id
  FROM events e JOIN logs l ON l.ingest_seq = e.event_id
  WHERE e.event_id % 50 NOT IN ({NOT_JSON}, {NUMBER_ID}, {BAD_TIME}, {TRAILING}, {LIST_BODY}, {LABEL_TYPE})
)"""

DECODED_SQL = "event_id, id, ts_us, source, level, message, label_k, trace_id"


def decoded_out(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(
        *keys, "id", as_micros(F.col("timestamp")).alias("ts_us"), "source", "level", "message",
        F.col("labels")["k"].alias("label_k"), "trace_id")
