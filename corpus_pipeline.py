"""From raw documents to packed sequences: language, exact copies, near copies, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import stages
from emberlog.session import shared_dir

STAGES = [
    ("language_id", stages.language_id),
    ("exact_dedup", stages.drop_copies),
    ("near_dedup", stages.drop_near_copies),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack_sequences),
]

#: Language identification, the near-duplicate search and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the output of each is a table in the shared folder that the next one reads."""
    base = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
