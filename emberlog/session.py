"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "emberlog", **settings: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. Dots in the names of further
    settings are written as double underscores."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    for name, value in settings.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="emberlog-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's `spark.checkpoint.dir`; only a local session without that
    setting falls back to a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, purpose: str) -> DataFrame:
    """Write a reduced table to the shared folder and read it back.

    It is then computed once, survives lost executors, and has a known size, so Spark broadcasts it in
    a join when it is small and shuffles both sides when it is not.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def set_meanwhile(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Settings for what starts inside: a stream keeps those of its start."""
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
