"""Counters, histograms, quantiles, rates and lag over the test tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from emberlog.functions.timefmt import as_micros
from emberlog.operators.counters import active_partitions, consumer_lag, lag_by_group, query_counts
from emberlog.operators.histograms import (
    COMPACTION_BOUNDS, INGEST_BOUNDS, PRODUCE_BOUNDS, QUERY_BOUNDS, floor_rank_quantile, histogram_quantile,
    latency_histogram,
)
from emberlog.operators.rates import (
    bucket_rate_quantile, counter_increments, counter_rate, event_rate, sliding_quantile, slot_start,
)
from emberlog.operators.reconcile import lost, reconcile, recovered, totals
from emberlog.session import shared_dir
from emberlog.sources.samples import read_samples, series
from emberlog.workload.fixtures import events, table
from emberlog.workload.registry import query


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as one timed request: seconds, source and tier."""
    tier = F.when(F.col("user_id") % 3 == 0, "hot").when(F.col("user_id") % 3 == 1, "cold").otherwise("tiered")
    return events(spark, sf).select(
        "event_id", "ts", F.col("event_type").alias("source"), tier.alias("tier"),
        (F.col("value") / F.lit(1000)).alias("seconds"))


LATENCIES_CTE = """
latencies AS (
  SELECT event_id, ts, event_type AS source,
         CASE user_id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN 'cold' ELSE 'tiered' END AS tier, value / 1000 AS seconds
  FROM events
)"""


def _bounds_sql(bounds: list[float]) -> str:
    values = ", ".join(f"({b!r}::DOUBLE)" for b in bounds)
    return f"(VALUES {values}, ('Infinity'::DOUBLE)) AS bounds(le)"


def _histogram_sql(bounds: list[float], by: str | None) -> str:
    key, group = (f"{by}, ", f"{by}, le") if by else ("", "le")
    return f"""WITH {LATENCIES_CTE} SELECT {key}le, count(*) FILTER (seconds <= le) AS count,
        count(*) AS observations, round(sum(seconds), 6) AS total
      FROM latencies CROSS JOIN {_bounds_sql(bounds)} GROUP BY {group}"""


def _rounded(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


@query(_histogram_sql(INGEST_BOUNDS, "source"))
def latency_histogram_ingest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(latency_histogram(latencies(spark, sf), "seconds", INGEST_BOUNDS, ["source"]), "total")


@query(_histogram_sql(PRODUCE_BOUNDS, None))
def latency_histogram_produce(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(latency_histogram(latencies(spark, sf), "seconds", PRODUCE_BOUNDS), "total")


@query(_histogram_sql(QUERY_BOUNDS, "tier"))
def latency_histogram_query(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(latency_histogram(latencies(spark, sf), "seconds", QUERY_BOUNDS, ["tier"]), "total")


@query(_histogram_sql(COMPACTION_BOUNDS, None))
def latency_histogram_compaction(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(latency_histogram(latencies(spark, sf), "seconds", COMPACTION_BOUNDS), "total")


@query(f"""WITH {LATENCIES_CTE} SELECT tier, CASE WHEN seconds > 0.2 THEN 'error' ELSE 'success' END AS status,
    count(*) AS queries FROM latencies GROUP BY 1, 2""")
def query_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("seconds") > 0.2, "error").otherwise("success")
    return query_counts(latencies(spark, sf).withColumn("status", status))


def _quantile_sql(buckets: str, by: str, count: str = "count", ctes: str = "") -> str:
    """Histogram quantile 0.95 over a CTE of (by.., le, count)."""
    return f"""{ctes}
    edged AS (
      SELECT {by}, le, {count}::DOUBLE AS c,
             coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag({count}::DOUBLE) OVER w, 0) AS below,
             CAST(0.95 AS DOUBLE) * max({count}::DOUBLE) FILTER (isinf(le)) OVER (PARTITION BY {by}) AS rank,
             max({count}::DOUBLE) FILTER (isinf(le)) OVER (PARTITION BY {by}) AS total
      FROM {buckets} WINDOW w AS (PARTITION BY {by} ORDER BY le)),
    found AS (
      SELECT {by}, min_by(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - below) / (c - below) END, le)
               FILTER (c >= rank AND total > 0) AS quantile
      FROM edged GROUP BY {by})"""


@query(f"""WITH {LATENCIES_CTE}, b AS (SELECT tier, le, count(*) FILTER (seconds <= le) AS count
      FROM latencies CROSS JOIN {_bounds_sql(QUERY_BOUNDS)} GROUP BY tier, le),
    {_quantile_sql('b', 'tier')} SELECT tier, round(quantile, 6) AS quantile FROM found""")
def histogram_p95(spark: SparkSession, sf: str) -> DataFrame:
    buckets = latency_histogram(latencies(spark, sf), "seconds", QUERY_BOUNDS, ["tier"])
    return _rounded(histogram_quantile(buckets, 0.95, ["tier"]), "quantile")


HOUR = timedelta(hours=1)
HOUR_US = 3_600_000_000
SERIES_START_US = 1_704_844_800_000_000


def bucket_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly samples of cumulative bucket counters per instance and tier; each counter restarts daily."""
    timed = latencies(spark, sf).withColumn("instance", F.col("event_id") % 4)
    hour = slot_start(F.col("ts"), HOUR)
    per_hour = latency_histogram(timed, "seconds", QUERY_BOUNDS, ["instance", "tier", hour.alias("hour")])
    day = F.floor(F.col("hour") / F.lit(24 * HOUR_US))
    since_restart = (Window.partitionBy("instance", "tier", "le", day).orderBy("hour")
                     .rowsBetween(Window.unboundedPreceding, 0))
    return per_hour.select(
        F.timestamp_micros("hour").alias("ts"), "instance", "tier", "le",
        F.sum("count").over(since_restart).cast("double").alias("value"))


SAMPLES_CTE = LATENCIES_CTE + f""",
per_hour AS (
  SELECT event_id % 4 AS instance, tier, epoch_us(ts) // {HOUR_US} * {HOUR_US} AS hour, le,
         count(*) FILTER (seconds <= le) AS n
  FROM latencies CROSS JOIN {_bounds_sql(QUERY_BOUNDS)} GROUP BY 1, 2, 3, 4),
samples AS (
  SELECT hour, instance, tier, le, sum(n) OVER (PARTITION BY instance, tier, le, hour // {24 * HOUR_US}
         ORDER BY hour)::DOUBLE AS value FROM per_hour),
grown AS (
  SELECT *, coalesce(CASE WHEN value < p THEN value ELSE value - p END, 0) AS increase FROM (
    SELECT *, lag(value) OVER (PARTITION BY instance, tier, le ORDER BY hour) AS p FROM samples))"""


@query(f"""WITH {SAMPLES_CTE},
    r AS (SELECT tier, hour - o.k * {HOUR_US} AS window_start, le, sum(increase) / 21600 AS rate
      FROM grown CROSS JOIN (SELECT unnest(range(6)) AS k) AS o GROUP BY 1, 2, 3),
    {_quantile_sql('r', 'tier, window_start', 'rate')}
    SELECT tier, window_start, round(quantile, 6) AS quantile FROM found""")
def bucket_rate_p95(spark: SparkSession, sf: str) -> DataFrame:
    """p95 per tier from the rates of bucket counters, over six hours at every hour."""
    result = bucket_rate_quantile(
        bucket_samples(spark, sf), ["tier"], ["instance", "tier"], length=6 * HOUR, step=HOUR)
    return _rounded(result, "quantile")


STEP_US = 15_000_000


@query(f"""SELECT event_type, epoch_us(ts) // {STEP_US} * {STEP_US} - o.k * {STEP_US} AS window_start,
    count(*) AS events, round(count(*) / 300.0, 6)::DOUBLE AS rate
  FROM events CROSS JOIN (SELECT unnest(range(20)) AS k) AS o GROUP BY 1, 2""")
def rate_5m(spark: SparkSession, sf: str) -> DataFrame:
    """Events per second over five minutes, every 15 seconds."""
    return _rounded(event_rate(events(spark, sf), "ts", ["event_type"]), "rate")


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of one counter per event type; a smaller reading is a restart."""
    return events(spark, sf).select("event_id", "event_type", "ts", "value")


COUNTERS_CTE = """
stepped AS (
  SELECT event_id, event_type, ts, value,
         lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS p FROM events),
grown AS (
  SELECT *, coalesce(CASE WHEN value < p THEN value ELSE value - p END, 0) AS increase FROM stepped)"""


@query(f"WITH {COUNTERS_CTE} SELECT event_id, event_type, round(increase, 6) AS increase FROM grown")
def counter_increase(spark: SparkSession, sf: str) -> DataFrame:
    grown = counter_increments(counters(spark, sf), ["event_type"], tie_break=["event_id"])
    return _rounded(grown.select("event_id", "event_type", "increase"), "increase")


@query(f"""WITH {COUNTERS_CTE} SELECT event_type, epoch_us(ts) // {HOUR_US} * {HOUR_US} - o.k * {HOUR_US}
      AS window_start, round(sum(increase), 4) AS increase, round(sum(increase) / 21600, 9) AS rate
  FROM grown CROSS JOIN (SELECT unnest(range(6)) AS k) AS o GROUP BY 1, 2""")
def counter_rate_6h(spark: SparkSession, sf: str) -> DataFrame:
    """Counter increase per second over six hours, every hour."""
    rates = counter_rate(
        counters(spark, sf), ["event_type"], length=6 * HOUR, step=HOUR, tie_break=["event_id"])
    return _rounded(_rounded(rates, "rate", 9), "increase", 4)


def _sliding_sql(step_us: int, copies: int) -> str:
    return f"""WITH {LATENCIES_CTE},
    slotted AS (SELECT tier, epoch_us(ts) // {step_us} * {step_us} AS slot, le, count(*) FILTER (seconds <= le) AS n
      FROM latencies CROSS JOIN {_bounds_sql(QUERY_BOUNDS)} GROUP BY 1, 2, 3),
    b AS (SELECT tier, slot - o.k * {step_us} AS window_start, le, sum(n) AS count
      FROM slotted CROSS JOIN (SELECT unnest(range({copies})) AS k) AS o GROUP BY 1, 2, 3),
    {_quantile_sql('b', 'tier, window_start')}
    SELECT tier, window_start, round(quantile, 6) AS quantile FROM found"""


@query(_sliding_sql(STEP_US, 20))
def sliding_latency(spark: SparkSession, sf: str) -> DataFrame:
    """p95 per tier over five minutes, every 15 seconds."""
    return _rounded(sliding_quantile(latencies(spark, sf), "ts", "seconds", QUERY_BOUNDS, ["tier"]), "quantile")


@query(f"""WITH {LATENCIES_CTE}, r AS (
    SELECT source, seconds, row_number() OVER (PARTITION BY source ORDER BY seconds) AS rn,
           greatest(floor(count(*) OVER (PARTITION BY source) * CAST(0.95 AS DOUBLE)), 1) AS rank FROM latencies)
  SELECT source, seconds AS quantile FROM r WHERE rn = rank""")
def floor_p95(spark: SparkSession, sf: str) -> DataFrame:
    return floor_rank_quantile(latencies(spark, sf), "seconds", ["source"])


@query("""WITH r AS (
    SELECT l_returnflag, l_extendedprice AS v,
           row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn,
           greatest(floor(count(*) OVER (PARTITION BY l_returnflag) * CAST(0.95 AS DOUBLE)), 1) AS rank FROM lineitem)
  SELECT l_returnflag, v AS quantile FROM r WHERE rn = rank""")
def floor_p95_prices(spark: SparkSession, sf: str) -> DataFrame:
    """The same quantile over many distinct values in few groups."""
    return floor_rank_quantile(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])


def lag_samples(spark: SparkSession, sf: str) -> DataFrame:
    """One lag sample per event: 12 partitions in 3 consumer groups; some high water marks are behind."""
    return events(spark, sf).select(
        "ts", F.concat(F.lit("group-"), (F.col("user_id") % 3).cast("string")).alias("consumer_group"),
        (F.col("user_id") % 12).alias("partition"),
        (F.col("event_id") + F.floor("value") - 20).alias("high_water_mark"), F.col("event_id").alias("offset"))


LAG_CTE = """
lag_samples AS (
  SELECT ts, 'group-' || (user_id % 3) AS consumer_group, user_id % 12 AS partition,
         event_id + CAST(floor(value) AS BIGINT) - 20 AS high_water_mark, event_id AS "offset" FROM events),
latest AS (
  SELECT consumer_group, partition, greatest(high_water_mark - "offset" - 1, 0) AS lag FROM lag_samples
  QUALIFY row_number() OVER (PARTITION BY consumer_group, partition ORDER BY ts DESC, "offset" DESC) = 1)"""


@query(f"WITH {LAG_CTE} SELECT consumer_group, partition, lag FROM latest")
def consumer_lag_by_partition(spark: SparkSession, sf: str) -> DataFrame:
    return consumer_lag(lag_samples(spark, sf))


@query(f"WITH {LAG_CTE} SELECT consumer_group, CAST(sum(lag) AS BIGINT) AS lag FROM latest GROUP BY 1")
def consumer_lag_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return lag_by_group(consumer_lag(lag_samples(spark, sf)))


@query(f"""WITH {LAG_CTE} SELECT consumer_group, count(DISTINCT partition) AS active_partitions
    FROM lag_samples GROUP BY 1""")
def active_partitions_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return active_partitions(lag_samples(spark, sf))


def _delivery(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as sent ids, line items as stored copies."""
    sent = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    stored = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"))
    return sent, stored


DELIVERY_CTE = """
copies AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1),
judged AS (
  SELECT s.id, coalesce(n, 0) AS copies, CASE WHEN n IS NULL THEN 'lost' WHEN n = 1 THEN 'delivered'
         ELSE 'redelivered' END AS status
  FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id FROM orders) s LEFT JOIN copies c ON s.id = c.id)"""


@query(f"WITH {DELIVERY_CTE} SELECT id, copies, status FROM judged")
def delivery_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile(*_delivery(spark, sf))


@query(f"""WITH {DELIVERY_CTE} SELECT count(*) AS sent, count(*) FILTER (status <> 'lost') AS recovered,
    count(*) FILTER (status = 'lost') AS lost, count(*) FILTER (status = 'redelivered') AS redelivered,
    CAST(sum(greatest(copies - 1, 0)) AS BIGINT) AS extra_copies FROM judged""")
def delivery_totals(spark: SparkSession, sf: str) -> DataFrame:
    return totals(reconcile(*_delivery(spark, sf)))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def delivery_lost(spark: SparkSession, sf: str) -> DataFrame:
    return lost(*_delivery(spark, sf))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def delivery_recovered(spark: SparkSession, sf: str) -> DataFrame:
    return recovered(*_delivery(spark, sf))


@query(f"""SELECT epoch_us(ts) AS ts_us, CAST(user_id % 4 AS VARCHAR) AS shard, '' AS zone, value FROM events
    WHERE event_type = 'click' AND epoch_us(ts) BETWEEN {SERIES_START_US} AND {SERIES_START_US} + 86400000000 * 9""")
def metric_series(spark: SparkSession, sf: str) -> DataFrame:
    """One metric of stored samples over nine days, with its labels as columns; a label that is missing is empty."""
    path = shared_dir(spark, "samples")
    labels = F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string"))
    events(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.lit("_total")).alias("name"), labels.alias("labels"),
        F.lit(None).cast("double").alias("le"), "value").write.parquet(path)
    start = datetime.fromtimestamp(SERIES_START_US // 1_000_000, timezone.utc)
    found = series(read_samples(spark, path), "click_total", ("shard", "zone"), start, start + timedelta(days=9))
    return found.select(as_micros(F.col("ts")).alias("ts_us"), "shard", "zone", "value")
