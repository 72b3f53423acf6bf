import random
from datetime import timedelta

import numpy as np
import pytest
from emberlog.plans.query import LogQuery
from emberlog.plans.search import with_position
from emberlog.schema import ARRIVAL
from emberlog.sources.objects import bloom_words, may_contain, summarise, trigrams_of
from emberlog.sources.tables import LogTables
from pyspark.sql import functions as F
from tests.helpers import NOW, batch, plain, plan

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


@pytest.fixture
def tables(spark, tmp_path):
    return LogTables(spark, str(tmp_path / "tables"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_filters_never_deny_what_is_there(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé漢 019", k=rng.randint(0, 40))) for _ in range(200)]
    words = bloom_words(np.unique(np.concatenate([trigrams_of(t) for t in texts])))
    df = spark.createDataFrame([(words.tolist(),)], "w array<long>")
    asked = [t[a:a + rng.randint(0, 9)] for t in texts for a in [rng.randint(0, 20)]]
    admitted = df.select(*[may_contain(F.col("w"), t).alias(f"c{i}") for i, t in enumerate(asked)]).first()
    assert all(admitted)
    strange = ["".join(rng.choices("xyzw#", k=12)) for _ in range(200)]
    assert not any(df.select(*[may_contain(F.col("w"), t).alias(f"c{i}") for i, t in enumerate(strange)]).first())


def test_trigrams_stay_inside_texts():
    assert len(trigrams_of("ab")) == 0 and len(trigrams_of("")) == 0
    assert len(trigrams_of("aaaa")) == 1 and len(trigrams_of("é漢")) == 3


def test_summaries_of_odd_rows(spark, tmp_path):
    rows = [("1", NOW, "api", "INFO", None, None, None, None), ("2", None, None, None, "x" * 100, None, None, None), ("3", NOW + DAY, "web", "", "", None, None, None)]
    plain(spark, rows).coalesce(1).write.parquet(str(tmp_path / "t"))
    (line,) = summarise(spark.read.parquet(str(tmp_path / "t"))).collect()
    assert line.rows == 3 and line.sources == ["api", "web"] and line.levels == ["", "INFO"]
    assert line.max_us - line.min_us == DAY // timedelta(microseconds=1) and line.bytes > 0
    many = [(str(i), NOW, f"s{i}", "INFO", "m", None, None, None) for i in range(300)]
    plain(spark, many).coalesce(1).write.parquet(str(tmp_path / "u"))
    assert summarise(spark.read.parquet(str(tmp_path / "u"))).first().sources is None
    plain(spark, []).write.parquet(str(tmp_path / "v"))
    assert summarise(spark.read.parquet(str(tmp_path / "v"))).count() == 0


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    return month(spark, LogTables(spark, str(tmp_path_factory.mktemp("stored") / "tables")))


def month(spark, tables, cluster=()):
    rng = random.Random(8)
    for n in range(3):
        rows = []
        for i in range(400):
            at = NOW - timedelta(hours=rng.randint(8, 700), seconds=rng.randint(0, 3600))
            source = "rare" if i % 40 == 0 else rng.choice(["api", "web", "db"])
            rows.append((f"{n}-{i}", at, source, rng.choice(["INFO", "ERROR"]), f"request {n * 400 + i} of {source}", None, None, None))
        tables.append(plain(spark, rows).coalesce(1), n)
        if n < 2:
            tables.compact(NOW, rows_per_file=10, cluster=cluster)
    return tables


def test_text_searches_read_candidate_files_only(stored):
    tables = stored
    everything = LogQuery(start=NOW - 40 * DAY, end=NOW)
    total = len(tables.objects(everything, NOW))
    assert total >= 40
    for text in ("request 17", "77 of api", "of", "", "not there", "quest 5"):
        query = LogQuery(start=NOW - 40 * DAY, end=NOW, text=text, limit=2000)
        found = tables.search(query, NOW)
        assert ids(found) == ids(tables.stored().filter(F.col("message").contains(text)))
    assert tables.objects(LogQuery(start=NOW - 40 * DAY, end=NOW, text="not there"), NOW) == []
    few = tables.objects(LogQuery(start=NOW - 40 * DAY, end=NOW, text="request 177 "), NOW)
    assert 1 <= len(few) < total / 3
    read = tables.cold(query=LogQuery(text="request 177 ", start=NOW - 40 * DAY, end=NOW))
    assert len(read.inputFiles()) == len(few)


def test_clustering_prunes_a_rare_source(spark, tables):
    month(spark, tables, cluster=("source", "level"))
    everything = tables.objects(LogQuery(start=NOW - 40 * DAY, end=NOW), NOW)
    rare = tables.objects(LogQuery(start=NOW - 40 * DAY, end=NOW, source="rare"), NOW)
    share = tables.cold().filter("source = 'rare'").count() / tables.cold().count()
    assert share < 0.05
    # A file of ten rows of a day holds the rare rows of the day beside some others.
    assert sum(o.bytes for o in rare) < 0.5 * sum(o.bytes for o in everything)
    query = LogQuery(start=NOW - 40 * DAY, end=NOW, source="rare", limit=1000)
    assert ids(tables.search(query, NOW)) == ids(tables.stored().filter("source = 'rare'"))
    assert tables.cold().count() == 800 and "_place" not in tables.cold().columns


@pytest.mark.parametrize("order, limit", [("arrival", 1), ("arrival", 60), ("newest", 7), ("newest", 5000)])
def test_early_stop_gives_the_rows_of_the_search(stored, order, limit):
    tables = stored
    for more in ({}, {"source": "rare"}):
        query = LogQuery(start=NOW - 20 * DAY, end=NOW, limit=limit, order=order, **more)
        found = tables.search_first(query, NOW)
        assert [r.id for r in found.rows.collect()] == [r.id for r in tables.search(query, NOW).collect()]
        if limit < 10 and not more:
            assert found.cold.parts_read <= 3 < found.cold.parts


def test_early_stop_over_hot_batches(spark, tables):
    for n in range(12):
        tables.append(plain(spark, batch(5, f"b{n}", NOW - n * timedelta(minutes=1))), n)
    query = LogQuery(start=NOW - HOUR, end=NOW + HOUR, limit=8)
    found = tables.search_first(query, NOW)
    assert [r.id for r in found.rows.collect()] == [r.id for r in tables.search(query, NOW).collect()]
    assert found.hot.parts == 12 and found.hot.parts_read == 3 and found.cold is None
    assert tables.search_first(LogQuery(start=NOW - HOUR, end=NOW, source="none"), NOW).rows.count() == 0
    assert with_position(found.rows, arrival=ARRIVAL).count() == 8


def test_tables_without_an_index_are_read_whole(spark, stored):
    tables = LogTables(spark, stored.root)
    state = tables.snapshot()
    for entry in state.cold:
        del entry["indexed"]
    tables.snapshot = lambda: state
    query = LogQuery(start=NOW - 40 * DAY, end=NOW, source="rare", limit=9)
    expected = ids(tables.stored().filter("source = 'rare'"))
    assert ids(tables.search(LogQuery(start=NOW - 40 * DAY, end=NOW, source="rare", limit=1000), NOW)) == expected
    assert [r.id for r in tables.search_first(query, NOW).rows.collect()] == [r.id for r in tables.search(query, NOW).collect()]


def test_a_torn_batch_is_invisible(spark, tables):
    tables.append(plain(spark, batch(4, "a", NOW)), 0)
    move, moved = tables.folder.move, []

    def die_after_one(old, new):
        if moved:
            raise RuntimeError("killed")
        moved.append(new)
        move(old, new)

    tables.folder.move = die_after_one
    with pytest.raises(RuntimeError):
        tables.append(plain(spark, batch(40, "b", NOW)).repartition(4), 1)
    tables.folder.move = move
    assert len(moved) == 1 and ids(tables.hot()) == [f"a-{i}" for i in range(4)]
    assert tables.search(LogQuery(start=NOW - HOUR, end=NOW + HOUR), NOW).count() == 4
    assert "file_name" in plan(tables.hot())
    # A replay that dies leaves the batch as it was; one that finishes replaces it in one step.
    tables.append(plain(spark, batch(6, "b", NOW)), 1)
    publish, tables.folder.publish = tables.folder.publish, lambda *_: False
    with pytest.raises(RuntimeError):
        tables.append(plain(spark, batch(9, "c", NOW)), 1)
    tables.folder.publish = publish
    assert ids(tables.hot()) == [f"a-{i}" for i in range(4)] + [f"b-{i}" for i in range(6)]
    tables.append(plain(spark, batch(2, "d", NOW)), 1)
    assert ids(tables.hot()) == [f"a-{i}" for i in range(4)] + ["d-0", "d-1"]
    assert tables.batches().filter("batch_id = 1").first().accepted == 2
    assert len({p.split("-")[2] for p in tables.folder.glob("hot/new/0-1-*")}) == 1
