"""Searches: every predicate alone, combined, and the tiered request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.retention import drain
from emberlog.plans.query import LogQuery
from emberlog.plans.search import envelope, matches, search, summarize, with_position
from emberlog.workload.fixtures import AS_OF, CUTOFF, LOGS_CTE, OUT_SQL, logs, out, table
from emberlog.workload.registry import query


def _where(condition: str) -> str:
    return f"WITH {LOGS_CTE} SELECT {OUT_SQL} FROM logs WHERE {condition}"


@query(_where("\"timestamp\" BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"))
def search_time_range(spark: SparkSession, sf: str) -> DataFrame:
    return out(LogQuery(start="2024-01-10 00:00:00", end="2024-01-20 12:00:00").match(logs(spark, sf)))


@query(_where("source = 'purchase'"))
def search_source(spark: SparkSession, sf: str) -> DataFrame:
    return out(LogQuery(source="purchase").match(logs(spark, sf)))


@query(_where("level = 'FATAL'"))
def search_level(spark: SparkSession, sf: str) -> DataFrame:
    return out(LogQuery(level="FATAL").match(logs(spark, sf)))


@query(_where("contains(message, '7 from error')"))
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    return out(LogQuery(text="7 from error").match(logs(spark, sf)))


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, source, length(text) AS chars FROM documents
          WHERE contains(text, 'the ') AND lang = 'en'""")
def search_text_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Substring search over long texts taken as messages, with the language as level."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"),
        "source", F.col("lang").alias("level"), F.col("text").alias("message"))
    return LogQuery(level="en", text="the ").match(docs).select(
        "id", "source", F.length("message").cast("long").alias("chars"))


@query(_where("label_k = '42'"))
def search_labels(spark: SparkSession, sf: str) -> DataFrame:
    return out(LogQuery(labels={"k": "42"}).match(logs(spark, sf)))


def _regional(spark: SparkSession, sf: str) -> DataFrame:
    """The logs, one in four with a second label."""
    region = F.map_concat("labels", F.create_map(F.lit("region"), F.lit("eu")))
    return logs(spark, sf).withColumn("labels", F.when(F.col("ingest_seq") % 4 == 1, region).otherwise(F.col("labels")))


@query(_where("label_k = '7' AND ingest_seq % 4 <> 1"))
def search_labels_empty_value(spark: SparkSession, sf: str) -> DataFrame:
    """A wanted '' matches entries without the key."""
    return out(LogQuery(labels={"k": "7", "region": ""}).match(_regional(spark, sf)))


@query(_where("label_k = '42' AND ingest_seq % 4 = 1"))
def search_labels_both(spark: SparkSession, sf: str) -> DataFrame:
    """Every wanted label must be there."""
    return out(LogQuery(labels={"k": "42", "region": "eu"}).match(_regional(spark, sf)))


COMBINED = LogQuery(start="2024-01-05 00:00:00", end="2024-01-25 00:00:00", source="error", level="ERROR",
                    text="1 from", labels={"region": ""})
COMBINED_SQL = """"timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
  AND source = 'error' AND level = 'ERROR' AND contains(message, '1 from')
  AND ingest_seq % 4 <> 1"""


@query(_where(COMBINED_SQL))
def search_combined(spark: SparkSession, sf: str) -> DataFrame:
    return out(COMBINED.match(_regional(spark, sf)))


def _tiers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(hot, cold) as a compaction at AS_OF leaves them."""
    cold, hot = drain(logs(spark, sf), AS_OF)
    return hot, cold


def _result(spark: SparkSession, sf: str, request: LogQuery) -> DataFrame:
    hot, cold = _tiers(spark, sf)
    return out(with_position(search(hot, cold, request, AS_OF), request.order), "tier", "position")


def _tiered_sql(condition: str, limit: int, hot: bool = True, cold: bool = True) -> str:
    """Hot: first matches by arrival, shown newest first; cold: earliest matches; hot before cold."""
    per_tier = limit or 1000
    cut = f"LIMIT {limit}" if limit else ""
    parts = []
    if hot:
        parts.append(f"""SELECT * FROM (SELECT *, 'hot' AS tier, 0 AS tier_rank FROM logs
            WHERE "timestamp" >= TIMESTAMP '{CUTOFF}' AND {condition} ORDER BY ingest_seq LIMIT {per_tier})""")
    if cold:
        parts.append(f"""SELECT * FROM (SELECT *, 'cold' AS tier, 1 AS tier_rank FROM logs
            WHERE "timestamp" < TIMESTAMP '{CUTOFF}' AND {condition}
            ORDER BY "timestamp", ingest_seq LIMIT {per_tier})""")
    return f"""WITH {LOGS_CTE}, picked AS ({' UNION ALL '.join(parts)}),
      placed AS (SELECT *, row_number() OVER (ORDER BY tier_rank,
          CASE WHEN tier_rank = 0 THEN -epoch_us("timestamp") END, "timestamp", ingest_seq) AS position
        FROM picked)
      SELECT {OUT_SQL}, tier, position FROM placed ORDER BY position {cut}"""


@query(_tiered_sql("\"timestamp\" BETWEEN TIMESTAMP '2024-01-29 23:00:00' AND TIMESTAMP '2024-01-30 00:00:00'", 0,
                   cold=False))
def search_default_range(spark: SparkSession, sf: str) -> DataFrame:
    """No range given: the hour before AS_OF."""
    return _result(spark, sf, LogQuery())


@query(_tiered_sql("\"timestamp\" BETWEEN TIMESTAMP '2024-01-29 19:00:00' AND TIMESTAMP '2024-01-30 00:00:00'", 20,
                   cold=False))
def search_hot_only(spark: SparkSession, sf: str) -> DataFrame:
    return _result(spark, sf, LogQuery(start="2024-01-29 19:00:00", end=AS_OF, limit=20))


@query(_tiered_sql("\"timestamp\" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' "
                   "AND level = 'WARN'", 50, hot=False))
def search_cold_only(spark: SparkSession, sf: str) -> DataFrame:
    return _result(spark, sf, LogQuery(start="2024-01-03 00:00:00", end="2024-01-20 00:00:00", level="WARN", limit=50))


TIERED = LogQuery(start="2024-01-25 00:00:00", end=AS_OF, level="ERROR", text="from error", limit=50)
TIERED_SQL = f""""timestamp" BETWEEN TIMESTAMP '2024-01-25 00:00:00' AND TIMESTAMP '{AS_OF}'
  AND level = 'ERROR' AND contains(message, 'from error')"""


@query(_tiered_sql(TIERED_SQL, 50))
def search_tiered(spark: SparkSession, sf: str) -> DataFrame:
    return _result(spark, sf, TIERED)


@query(_tiered_sql(f"\"timestamp\" BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '{AS_OF}'", 0))
def search_limit_default(spark: SparkSession, sf: str) -> DataFrame:
    """Limit 0: up to 1000 rows of each tier, and no cut of the merged result."""
    return _result(spark, sf, LogQuery(start="2024-01-01 00:00:00", end=AS_OF))


@query(f"""WITH {LOGS_CTE}, placed AS (
    SELECT *, CASE WHEN "timestamp" >= TIMESTAMP '{CUTOFF}' THEN 'hot' ELSE 'cold' END AS tier,
           row_number() OVER (ORDER BY "timestamp" DESC, id) AS position
    FROM logs WHERE {TIERED_SQL})
  SELECT {OUT_SQL}, tier, position FROM placed WHERE position <= 50""")
def search_newest(spark: SparkSession, sf: str) -> DataFrame:
    return _result(spark, sf, LogQuery(**{**TIERED.__dict__, "order": "newest"}))


@query(f"""WITH {LOGS_CTE}, picked AS (
    SELECT * FROM (SELECT *, 'hot' AS tier FROM logs WHERE "timestamp" >= TIMESTAMP '{CUTOFF}' AND "timestamp" <= TIMESTAMP '{AS_OF}'
      ORDER BY "timestamp" DESC, id LIMIT 1000)
    UNION ALL SELECT * FROM (SELECT *, 'cold' AS tier FROM logs WHERE "timestamp" < TIMESTAMP '{CUTOFF}' ORDER BY "timestamp" DESC, id LIMIT 1000))
  SELECT {OUT_SQL}, tier, row_number() OVER (ORDER BY "timestamp" DESC, id) AS position FROM picked""")
def search_newest_unlimited(spark: SparkSession, sf: str) -> DataFrame:
    """Limit 0 does not cut the merged result in either order."""
    return _result(spark, sf, LogQuery(start="2024-01-01 00:00:00", end=AS_OF, order="newest"))


@query(f"""WITH {LOGS_CTE}, m AS (SELECT count(*) AS n FROM logs WHERE {TIERED_SQL})
  SELECT least(n, 50) AS total_count, n AS matched_count, 'tiered' AS tier FROM m""")
def search_summary(spark: SparkSession, sf: str) -> DataFrame:
    hot, cold = _tiers(spark, sf)
    return summarize(hot, cold, TIERED, AS_OF)


@query(f"""SELECT string_agg(id, ',' ORDER BY position) AS ids, count(*) AS total_count, 'tiered' AS tier
  FROM ({_tiered_sql(TIERED_SQL, 50)})""")
def search_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The response envelope; its entries are shown by their ids in order."""
    hot, cold = _tiers(spark, sf)
    return envelope(hot, cold, TIERED, AS_OF).select(
        F.array_join(F.transform("entries", lambda e: e["id"]), ",").alias("ids"), "total_count", "tier")


@query(f"""WITH {LOGS_CTE} SELECT CASE WHEN "timestamp" >= TIMESTAMP '{CUTOFF}' THEN 'hot' ELSE 'cold' END AS tier,
    level, count(*) AS entries FROM logs
  WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '{AS_OF}' GROUP BY ALL""")
def search_all_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every match of both tiers without a limit, counted by tier and level."""
    hot, cold = _tiers(spark, sf)
    found = matches(hot, cold, LogQuery(start="2024-01-02 00:00:00", end=AS_OF), AS_OF)
    return found.groupBy("tier", "level").agg(F.count(F.lit(1)).alias("entries"))
