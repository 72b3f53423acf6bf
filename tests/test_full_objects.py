"""Cold objects of a fixed number of rows, written by many tasks."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.plans.query import LogQuery
from emberlog.sources.tables import LogTables
from tests.helpers import NOW, plain


@pytest.fixture
def tables(spark, tmp_path):
    return LogTables(spark, str(tmp_path / "tables"))


def rows(n, days=1):
    return [(f"r{i}", NOW - timedelta(hours=9, days=i % days, seconds=i % 977), "s", "INFO", f"m {i}", None, None, None) for i in range(n)]


@pytest.mark.parametrize("files", [None, 1, 4])
def test_objects_are_full_whatever_the_number_of_tasks(spark, tables, files):
    tables.append(plain(spark, rows(5_230, 2)).repartition(8), 0)
    tables.compact(NOW, files=files, rows_per_file=50)
    objects = (tables.cold().groupBy("dt", F.col("_metadata.file_path").alias("object"))
               .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).orderBy("dt", "low", "high").collect())
    for day in {o.dt for o in objects}:
        own = [o for o in objects if o.dt == day]
        # 2,615 rows a day: 52 full objects and the rest, in order of time.
        assert sorted(o.n for o in own) == [15, *[50] * 52]
        assert all(a.high <= b.low for a, b in zip(own, own[1:]))
    # The name of an object begins with the number of its task.
    assert len({o.object.rsplit("/", 1)[1].split("-")[1] for o in objects}) > 1
    assert tables.cold().select("id").distinct().count() == 5_230
    assert tables.folder.glob("hot/tmp/*") == []


def test_the_index_of_small_objects_is_a_few_files(spark, tables):
    tables.append(plain(spark, rows(1_500)), 0)
    tables.compact(NOW, rows_per_file=2)
    assert len(tables.objects(LogQuery(start=NOW - timedelta(days=3), end=NOW), NOW)) == 750
    assert len(tables.folder.glob("cold-index/*/*.parquet")) <= 4 * spark.sparkContext.defaultParallelism
