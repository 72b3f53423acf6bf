import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.functions.routing import fnv1a_32, routing_key
from emberlog.functions.timefmt import as_micros
from emberlog.sources.archive import read_archive, skipped_objects, write_archive
from emberlog.sources.records import (
    acknowledgements, decode_records, explode_bodies, good, publish_files, quarantined, to_records,
)
from tests.helpers import NOW, batch, logs, plan

AS_OF = "2024-05-01T00:00:00Z"

ACCEPTED = {
    '{"id":"a"}': ("a", AS_OF),
    ' {"id":"a"} ': ("a", AS_OF),
    "null": (None, AS_OF),
    "{}": (None, AS_OF),
    '{"id":null,"timestamp":null,"labels":null}': (None, AS_OF),
    '{"id":"a","unknown":[1,{"x":2}]}': ("a", AS_OF),
    '{"id":"a","timestamp":"0001-01-01T00:00:00Z"}': ("a", AS_OF),
    '{"id":"a","timestamp":"2024-01-01T00:00:00.123456789+02:00"}': ("a", "2023-12-31T22:00:00.123456Z"),
    '{"id":"a","labels":{}}': ("a", AS_OF),
    '{"id":"a","labels":{"k":null}}': ("a", AS_OF),
}
REJECTED = [
    "not json", "", "[]", '[{"id":"a"}]', '"text"', "5", '{"id":1}', '{"id":true}', '{"id":{"x":1}}',
    '{"timestamp":"bad"}', '{"timestamp":"2024-01-01"}', '{"timestamp":"2024-01-01 00:00:00"}', '{"timestamp":17}',
    '{"timestamp":"2024-13-01T00:00:00Z"}', '{"timestamp":""}', '{"labels":[1]}', '{"labels":5}', '{"labels":{"k":1}}',
    '{"labels":{"k":{"x":"y"}}}', '{"id":"a"', '{"id":"a"} more', '{"id":"a"}{"id":"b"}', '{"id":"a"},{"id":"b"}',
]


def us(text):
    stamp = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int(stamp.timestamp()) * 1_000_000 + stamp.microsecond


def frame(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "n int, value string")


def test_accepted(spark):
    decoded = decode_records(frame(spark, list(ACCEPTED)), AS_OF)
    rows = decoded.withColumn("us", as_micros(F.col("timestamp"))).orderBy("n").collect()
    assert [(r.id, r.us) for r in rows] == [(i, us(t)) for i, t in ACCEPTED.values()]
    assert all(r.error_type is None and r.raw is None for r in rows)


def test_null_label_reads_as_empty(spark):
    row = good(decode_records(frame(spark, ['{"labels":{"k":null,"x":"1"}}']), AS_OF)).first()
    assert row.labels == {"k": "", "x": "1"}


def test_rejected(spark):
    decoded = decode_records(frame(spark, REJECTED), AS_OF)
    assert good(decoded).count() == 0
    bad = quarantined(decoded).orderBy("n").collect()
    assert [r.raw for r in bad] == REJECTED
    assert {r.error_type for r in bad} == {"unmarshal"}


def test_request_body_ignores_what_follows(spark):
    values = ['{"id":"a"} more', '{"id":"a"}{"id":"b"}']
    assert good(decode_records(frame(spark, values), AS_OF, allow_trailing=True)).count() == 2


def test_batches_are_all_or_nothing(spark):
    values = ['[{"id":"a"},{"id":"b"}]', '[{"id":"a"},{"id":5}]', "[]", "null", '{"id":"a"}', '["str",{"id":"a"}]',
              '[{"id":"a"},null]', "broken"]
    bodies = frame(spark, values)
    acks = {r.n: (r.accepted, r.ingested) for r in acknowledgements(bodies, AS_OF).collect()}
    assert acks == {0: (True, 2), 1: (False, 0), 2: (True, 0), 3: (True, 0), 4: (False, 0), 5: (False, 0), 6: (True, 2),
                    7: (False, 0)}
    entries = explode_bodies(bodies, AS_OF).orderBy("n", "entry_index").collect()
    assert [(r.n, r.entry_index, r.id) for r in entries] == [(0, 0, "a"), (0, 1, "b"), (6, 0, "a"), (6, 1, None)]
    assert all(r.timestamp is not None for r in entries)


def test_decoding_parses_once_and_stays_in_the_jvm(spark):
    text = plan(good(decode_records(frame(spark, ["{}"]), AS_OF)))
    assert text.count("parseJson") == 1
    assert "Python" not in text


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    texts = ["", "a", "api", "worker", "héllo", "日本語", "😀 x", "\x00zero", "z" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", fnv1a_32(F.col("s")).alias("h")).collect()
    assert [r.h for r in rows] == [fnv(t) for t in texts]


def test_routing_key(spark):
    rows = spark.createDataFrame(
        [("api", "t1"), ("api", ""), ("api", None), (None, None)], "source string, trace_id string")
    keys = [r.k for r in rows.select(routing_key(F.col("source"), F.col("trace_id")).alias("k")).collect()]
    assert keys == ["t1", str(fnv("api")), str(fnv("api")), str(fnv(""))]


def test_encoding_leaves_out_empty_fields(spark):
    rows = logs(spark, batch(1, "api", NOW), batch(1, "b", NOW.replace(microsecond=120_000), labels={"k": "v"}))
    values = [json.loads(r.value) for r in to_records(rows.orderBy("ingest_seq")).collect()]
    assert values[0] == {"id": "api-0", "timestamp": "2024-03-10T12:00:00Z", "source": "api", "level": "INFO",
                         "message": "message 0 from api"}
    assert values[1]["timestamp"] == "2024-03-10T12:00:00.12Z" and values[1]["labels"] == {"k": "v"}


def test_encode_decode_roundtrip(spark):
    rows = logs(spark, batch(20, "api", NOW, labels={"k": 'quote " and \\ slash'}))
    back = good(decode_records(to_records(rows).select("value"), AS_OF))
    columns = ["id", "timestamp", "source", "level", "message", "labels"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, rows.select(columns).collect()))


def test_published_files_keep_a_key_in_one_partition_without_a_shuffle(spark, tmp_path):
    path = str(tmp_path / "published")
    records = to_records(logs(spark, batch(200, "api", NOW), batch(50, "worker", NOW)))
    publish_files(records, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 250
    assert stored.groupBy("key").agg(F.count_distinct("partition").alias("p")).filter("p > 1").count() == 0
    assert "Exchange" not in plan(records)


def test_archive_skips_unreadable_objects(spark, tmp_path):
    folder = tmp_path / "archive" / "logs" / "2024" / "03" / "10"
    folder.mkdir(parents=True)
    def put(name, text):
        (folder / name).write_bytes(gzip.compress(text.encode()))
    put("1.json.gz", '[{"id":"a","timestamp":"2024-03-10T00:00:00Z"},{"id":"b","timestamp":"2024-03-10T00:00:01Z"}]')
    put("2.json.gz", '[{"id":"c"},{"id":5}]')
    put("3.json.gz", "no json")
    (folder / "4.json.gz").write_bytes(b"not gzip at all")
    put("5.json.gz", "[]")
    (folder / "6.json.gz").write_bytes(gzip.compress(b'[{"id":"d","timestamp":"2024-03-10T00:00:00Z"}]')[:-9])
    root = str(tmp_path / "archive")
    assert sorted(r.id for r in read_archive(spark, root).collect()) == ["a", "b"]
    skipped = {r.object.rsplit("/", 1)[1]: r.reason for r in skipped_objects(spark, root).collect()}
    assert skipped == {"2.json.gz": "entries", "3.json.gz": "entries", "4.json.gz": "gzip", "6.json.gz": "gzip"}


def test_archive_objects_that_cannot_be_read_fail_the_job(spark, tmp_path):
    """An object that vanishes after it was listed is an error of the store, not a bad object."""
    (tmp_path / "1.json.gz").write_bytes(gzip.compress(b'[{"id":"a","timestamp":"2024-03-10T00:00:00Z"}]'))
    entries = read_archive(spark, str(tmp_path))
    (tmp_path / "1.json.gz").unlink()
    with pytest.raises(Exception, match="1.json.gz|FILE_NOT_EXIST|does not exist"):
        entries.collect()


def test_archive_roundtrip_in_chunks(spark, tmp_path):
    rows = logs(spark, batch(95, "api", NOW, labels={"k": "v"}))
    path = str(tmp_path / "archive")
    write_archive(rows, path, chunk_rows=10, block=16)
    back = read_archive(spark, path)
    per_object = sorted(r["count"] for r in back.groupBy("object").count().collect())
    assert per_object == [5] + [10] * 9
    columns = ["id", "timestamp", "source", "level", "message", "labels"]
    assert sorted(map(str, back.select(columns).collect())) == sorted(map(str, rows.select(columns).collect()))
    files = list((tmp_path / "archive").rglob("*.gz"))
    stamps = [us(e["timestamp"]) for e in json.loads(gzip.decompress(files[0].read_bytes()))]
    assert stamps == sorted(stamps)
