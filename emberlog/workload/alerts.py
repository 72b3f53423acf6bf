"""Alerts, queue depth and load shedding over the test tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.operators.alerts import (
    AlertRule, backpressure_engaged, consumer_lag_growing, evaluate, high_query_latency,
)
from emberlog.operators.backpressure import dropped, hysteresis, running_depth, transitions
from emberlog.operators.counters import lag_series
from emberlog.operators.histograms import QUERY_BOUNDS
from emberlog.operators.ordered import seq_block
from emberlog.operators.rates import sliding_quantile
from emberlog.session import settled
from emberlog.workload.fixtures import events
from emberlog.workload.metrics import HOUR, HOUR_US, LATENCIES_CTE, _bounds_sql, _quantile_sql, latencies
from emberlog.workload.registry import query


def or_minus_one(name: str) -> F.Column:
    """Integers without a value are compared as -1."""
    return F.coalesce(name, F.lit(-1)).alias(name)


def _hold_sql(samples: str, keys: str, order: str, condition: str, hold_us: int, gap_us: int) -> str:
    """CTEs up to `held`: active, held_us and firing per sample of `samples`, by gaps and islands."""
    return f"""
    marked AS (SELECT *, coalesce({condition}, false) AS active FROM {samples}),
    changed AS (SELECT *, CASE WHEN active IS DISTINCT FROM lag(active) OVER (PARTITION BY {keys} ORDER BY {order})
      OR epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY {keys} ORDER BY {order}) > {gap_us} THEN 1 ELSE 0 END AS change FROM marked),
    islands AS (SELECT *, sum(change) OVER (PARTITION BY {keys} ORDER BY {order}) AS island FROM changed),
    held AS (SELECT *, CASE WHEN active THEN epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY {keys}, island) END
      AS held_us FROM islands),
    judged AS (SELECT *, coalesce(held_us >= {hold_us}, false) AS firing FROM held)"""


SPIKE = AlertRule("SlowRequests", "warning", 30.0, timedelta(hours=3))


@query(f"""WITH samples AS (SELECT event_id, user_id % 12 AS shard, ts, value FROM events),
    {_hold_sql('samples', 'shard', 'ts, event_id', 'value > 30', 10_800_000_000, 2 * HOUR_US)}
    SELECT event_id, shard, active, coalesce(held_us, -1) AS held_us, firing, 'SlowRequests' AS alert, 'warning' AS severity FROM judged""")
def alert_hold_for(spark: SparkSession, sf: str) -> DataFrame:
    """Value above a threshold for three hours without a break, per shard."""
    samples = events(spark, sf).select(
        "event_id", (F.col("user_id") % 12).alias("shard"), "ts", "value")
    return evaluate(SPIKE, samples, ["shard"], ["ts", "event_id"], max_gap=2 * HOUR).select(
        "event_id", "shard", "active", or_minus_one("held_us"), "firing", "alert", "severity")


P95_SQL = f"""
    slotted AS (SELECT epoch_us(ts) // {HOUR_US} * {HOUR_US} AS slot, le, count(*) FILTER (seconds * 3.5 <= le) AS n
      FROM latencies CROSS JOIN {_bounds_sql(QUERY_BOUNDS)} GROUP BY 1, 2),
    b AS (SELECT slot - o.k * {HOUR_US} AS window_start, le, sum(n) AS count
      FROM slotted CROSS JOIN (SELECT unnest(range(2)) AS k) AS o GROUP BY 1, 2),
    {_quantile_sql('b', 'window_start')},
    p95 AS (SELECT make_timestamp(window_start) AS ts, round(quantile, 6) AS value FROM found)"""


@query(f"""WITH {LATENCIES_CTE}, {P95_SQL}, {_hold_sql('p95', '1', 'ts', 'value > 0.5', 300_000_000, 2 * HOUR_US)}
    SELECT epoch_us(ts) AS ts_us, value, active, coalesce(held_us, -1) AS held_us, firing, 'HighQueryLatency' AS alert,
           'warning' AS severity FROM judged""")
def alert_high_query_latency(spark: SparkSession, sf: str) -> DataFrame:
    """The latency alert over a sliding p95 of all tiers together."""
    timed = latencies(spark, sf).withColumn("seconds", F.col("seconds") * 3.5)
    p95 = sliding_quantile(timed, "ts", "seconds", QUERY_BOUNDS, [], length=2 * HOUR, step=HOUR)
    samples = p95.select(F.timestamp_micros("window_start").alias("ts"), F.round("quantile", 6).alias("value"))
    return high_query_latency(samples, [], ["ts"], max_gap=2 * HOUR).select(
        F.unix_micros("ts").alias("ts_us"), "value", "active", or_minus_one("held_us"), "firing", "alert", "severity")


# A partition's sample holds until its next one or for six hours, at every full hour.
LAG_SERIES_CTE = f"""samples AS (
    SELECT 'group-' || (user_id % 7) AS consumer_group, user_id % 28 // 7 AS "partition", epoch_us(ts) AS us, event_id,
           CAST(floor(value * 500) AS BIGINT) AS lag FROM events),
  spans AS (SELECT *, least(us + 6 * {HOUR_US}, coalesce(lead(us) OVER (PARTITION BY consumer_group, "partition" ORDER BY us, event_id), us + 6 * {HOUR_US}))
    AS until FROM samples),
  steps AS (SELECT consumer_group, lag, unnest(range((us + {HOUR_US} - 1) // {HOUR_US}, (until + {HOUR_US} - 1) // {HOUR_US})) AS step FROM spans),
  series AS (SELECT consumer_group, make_timestamp(step * {HOUR_US}) AS ts, CAST(sum(lag) AS BIGINT) AS lag FROM steps GROUP BY consumer_group, step)"""


def group_lag(spark: SparkSession, sf: str) -> DataFrame:
    """Summed lag of seven groups with four partitions each, every hour."""
    samples = events(spark, sf).select(
        F.concat(F.lit("group-"), (F.col("user_id") % 7).cast("string")).alias("consumer_group"),
        F.floor(F.col("user_id") % 28 / 7).alias("partition"), "ts", F.col("event_id").alias("offset"),
        (F.floor(F.col("value") * 500) + F.col("event_id") + 1).alias("high_water_mark"))
    return lag_series(samples, HOUR, 6 * HOUR)


@query(f"WITH {LAG_SERIES_CTE} SELECT consumer_group, epoch_us(ts) AS ts_us, lag FROM series")
def consumer_lag_series(spark: SparkSession, sf: str) -> DataFrame:
    """A group's lag over time: the sum over its partitions' last samples at every step."""
    return group_lag(spark, sf).select("consumer_group", F.unix_micros("ts").alias("ts_us"), "lag")


@query(f"""WITH {LAG_SERIES_CTE}, {_hold_sql('series', 'consumer_group', 'ts', 'lag > 100000', 180_000_000, 2 * HOUR_US)}
    SELECT consumer_group, epoch_us(ts) AS ts_us, lag, active, coalesce(held_us, -1) AS held_us, firing, 'ConsumerLagGrowing' AS alert,
           'critical' AS severity FROM judged""")
def alert_consumer_lag(spark: SparkSession, sf: str) -> DataFrame:
    """The lag alert over the summed lag of each group."""
    return consumer_lag_growing(settled(group_lag(spark, sf), "lag-series"), ["ts"], max_gap=2 * HOUR).select(
        "consumer_group", F.unix_micros("ts").alias("ts_us"), "lag", "active", or_minus_one("held_us"), "firing", "alert", "severity")


# Small enough that small tables have several blocks to carry state between.
SMALL_BLOCK = 5000


def depth_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Queue-depth changes of eight ingestors: batches come in and leave again."""
    size = (F.col("event_id") % 50) + 1
    delta = F.when(F.col("event_type").isin("click", "view", "signup"), size).otherwise(-size)
    return events(spark, sf).select(
        (F.col("user_id") % 8).alias("ingestor"), F.col("event_id").alias("seq"), "ts", delta.alias("delta"))


@query("""SELECT user_id % 8 AS ingestor, event_id AS seq,
    CAST(sum(CASE WHEN event_type IN ('click', 'view', 'signup') THEN event_id % 50 + 1 ELSE -(event_id % 50 + 1) END)
      OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS BIGINT) AS depth FROM events""")
def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Depth after every change."""
    return running_depth(depth_changes(spark, sf), block=seq_block("seq", SMALL_BLOCK)).select("ingestor", "seq", "depth")


MAX_DEPTH = 60
COOL = timedelta(hours=4)
COOL_US = 14_400_000_000


def depth_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Depth checks of 64 ingestors, one per event."""
    return events(spark, sf).select(
        (F.col("user_id") % 64).alias("ingestor"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"),
        F.floor("value").alias("depth"))


# One step of the recursion advances every ingestor by one check.
STATES_CTE = f"""
numbered AS (
  SELECT user_id % 64 AS ingestor, event_id AS seq, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS depth,
         row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS rn FROM events),
fold AS (
  SELECT ingestor, rn, seq, us, depth, CASE WHEN depth > {MAX_DEPTH} THEN us END AS engaged FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.ingestor, n.rn, n.seq, n.us, n.depth,
         CASE WHEN f.engaged IS NULL THEN CASE WHEN n.depth > {MAX_DEPTH} THEN n.us END
              WHEN n.depth < {MAX_DEPTH // 2} AND n.us - f.engaged > {COOL_US} THEN NULL
              ELSE f.engaged END
  FROM fold f JOIN numbered n ON n.ingestor = f.ingestor AND n.rn = f.rn + 1),
states AS (
  SELECT ingestor, seq, us, depth, depth <= {MAX_DEPTH} AS accept, engaged IS NOT NULL AS active,
         engaged AS engaged_us FROM fold)"""


def shedding_states(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence is cut into four, so that state is carried whatever the size of the table."""
    samples = depth_samples(spark, sf)
    low, high = samples.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    return hysteresis(samples, MAX_DEPTH, COOL, block=seq_block("seq", -(-(high - low + 1) // 4)))


@query(f"WITH RECURSIVE {STATES_CTE} SELECT ingestor, seq, depth, accept, active, coalesce(engaged_us, -1) AS engaged_us FROM states")
def shedding_hysteresis(spark: SparkSession, sf: str) -> DataFrame:
    return shedding_states(spark, sf).select("ingestor", "seq", "depth", "accept", "active", or_minus_one("engaged_us"))


@query(f"""WITH RECURSIVE {STATES_CTE} SELECT ingestor, seq, CASE WHEN active THEN 'engaged' ELSE 'released' END AS event
  FROM (SELECT *, lag(active, 1, false) OVER (PARTITION BY ingestor ORDER BY seq) AS before FROM states)
  WHERE active <> before""")
def shedding_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return transitions(shedding_states(spark, sf), block=seq_block("seq", SMALL_BLOCK)).select("ingestor", "seq", "event")


@query(f"""SELECT user_id % 64 AS ingestor, count(*) FILTER (CAST(floor(value) AS BIGINT) > {MAX_DEPTH}) AS dropped
  FROM events GROUP BY 1""")
def shedding_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return dropped(depth_samples(spark, sf), MAX_DEPTH)


@query(f"""WITH RECURSIVE {STATES_CTE}, samples AS (SELECT ingestor, seq, make_timestamp(us) AS ts,
      active::INT AS value FROM states),
    {_hold_sql('samples', 'ingestor', 'ts, seq', 'value = 1', 120_000_000, 12 * HOUR_US)}
    SELECT ingestor, seq, active, coalesce(held_us, -1) AS held_us, firing, 'BackpressureEngaged' AS alert, 'warning' AS severity FROM judged""")
def alert_backpressure(spark: SparkSession, sf: str) -> DataFrame:
    """The shedding alert over the shedding state."""
    state = settled(shedding_states(spark, sf).select(
        "ingestor", "seq", "ts", F.col("active").cast("int").alias("value")), "states")
    return backpressure_engaged(state, ["ingestor"], ["ts", "seq"], "value", 12 * HOUR).select(
        "ingestor", "seq", "active", or_minus_one("held_us"), "firing", "alert", "severity")
