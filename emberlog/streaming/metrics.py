"""Streaming counts and latency windows, and the number of rows that come too late for them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from emberlog.operators.histograms import INF
from emberlog.schema import EVALUATION_STEP, RATE_WINDOW


def counts_per_step(logs: DataFrame, delay: str = "24 hours", step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Entries by source and level per step of event time, for append mode: a step comes out once, when the watermark has
    passed it. Rows more than `delay` behind the newest are dropped; `LateRows` counts them."""
    width = f"{int(step.total_seconds())} seconds"
    return (logs.withWatermark("timestamp", delay)
            .groupBy(F.window("timestamp", width), "source", "level")
            .agg(F.count(F.lit(1)).alias("entries"))
            .select(F.col("window.start").alias("start"), "source", "level", "entries"))


def sliding_buckets(observations: DataFrame, ts: str, value: str, bounds: Sequence[float], by: Sequence[str],
                    delay: str = "24 hours", length: timedelta = RATE_WINDOW, step: timedelta = EVALUATION_STEP) -> DataFrame:
    """Cumulative latency buckets per sliding window, for `histogram_quantile` over the stored rows.

    Observations are counted per step first; only the finished steps are spread over the windows. Rows more than
    `delay` behind the newest are dropped; `LateRows` counts them.
    """
    edges = [*bounds, INF]
    names = [f"_b{i}" for i in range(len(edges))]
    per_step = (observations.withWatermark(ts, delay)
                .groupBy(F.window(ts, f"{int(step.total_seconds())} seconds"), *by)
                .agg(*[F.count_if(F.col(value) <= F.lit(e)).alias(n) for e, n in zip(edges, names)]))
    windows = (per_step
               .groupBy(F.window(F.window_time("window"), f"{int(length.total_seconds())} seconds",
                                 f"{int(step.total_seconds())} seconds"), *by)
               .agg(*[F.sum(n).alias(n) for n in names]))
    rows = F.array(*[F.struct(F.lit(e).alias("le"), F.col(n).alias("count")) for e, n in zip(edges, names)])
    return windows.select(F.col("window.start").alias("window_start"), *by, F.inline(rows))


class LateRows(StreamingQueryListener):
    """Counts the rows that streaming aggregates drop because they come behind the watermark, per query.

    Add it with `spark.streams.addListener`; the counts cover every batch since then.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
