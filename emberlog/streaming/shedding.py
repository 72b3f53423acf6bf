"""Load-shedding state over a stream of queue-depth samples."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.backpressure import hysteresis
from emberlog.schema import COOLDOWN, MAX_QUEUE_DEPTH
from emberlog.sources.files import Folder
from emberlog.streaming.ingest import run_batches


def shed(samples: DataFrame, path: str, checkpoint: str, max_depth: int = MAX_QUEUE_DEPTH,
         cooldown: timedelta = COOLDOWN, key: str = "ingestor", available_now: bool = False) -> StreamingQuery:
    """Judge each micro-batch with the block-parallel batch operator and carry the state over.

    Writes `path/states/batch_id=<n>` and `path/carry/batch_id=<n>` (one row per ingestor). Batch n
    reads the newest earlier carry and replaces its own output, so a replayed batch gives the same rows.
    """
    spark = samples.sparkSession

    def judge(rows: DataFrame, batch_id: int) -> None:
        entry = carried(spark, path, batch_id)
        states = hysteresis(rows, max_depth, cooldown, key=key, entry=entry)
        target = f"{path}/states/batch_id={batch_id}"
        states.write.mode("overwrite").parquet(target)
        written = spark.read.schema(states.schema).parquet(target)
        latest = written.groupBy(key).agg(F.max_by("engaged_us", "seq").alias("engaged_us"))
        if entry is not None:
            # An ingestor without samples in this batch keeps its state.
            latest = latest.unionByName(entry.join(latest, key, "left_anti"))
        latest.write.mode("overwrite").parquet(f"{path}/carry/batch_id={batch_id}")
        # A replay of this batch needs the carry before it, nothing needs an older one.
        folder = Folder(spark, path)
        for old in folder.glob("carry/batch_id=*"):
            if int(old.split("=")[1]) < batch_id - 1:
                folder.delete(old)

    return run_batches(samples, judge, checkpoint, available_now)


def carried(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """State per ingestor after the newest finished batch before this one."""
    done = [int(p.split("/")[1].split("=")[1]) for p in Folder(spark, path).glob("carry/batch_id=*/_SUCCESS")]
    earlier = [n for n in done if n < before]
    return spark.read.parquet(f"{path}/carry/batch_id={max(earlier)}") if earlier else None
