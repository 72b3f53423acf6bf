import pytest

import __spark_entry__ as entry
import corpus_pipeline
from emberlog.llm import stages
from emberlog.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import CLASHING, documents
from tests.oracle import TESTDATA, compare, connect

SF = f"{TESTDATA}/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert compare(QUERIES[name](spark, f"{TESTDATA}/sf0.01"), connect(f"{TESTDATA}/sf0.01"), ORACLES[name]) is None


@pytest.fixture
def docs(spark, odd_rows, tmp_path):
    documents(spark, odd_rows).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def test_language_id(spark, docs):
    kept = stages.language_id(spark, docs, "")
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == sorted([1, 2, 2, None, 6, 7, 8, 9, 11], key=repr)


def test_drop_copies(spark, docs):
    kept = stages.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    # 1 and 2 are equal, the row 2 repeats; of the empty and null texts the largest id stays.
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 4, 5, None, 6, 7, 8, 9, 10, 11], key=repr)


def test_drop_near_copies(spark, docs):
    kept = stages.drop_near_copies(spark, stages.drop_copies(spark, docs, ""), "")
    assert kept.columns == docs.columns
    # 9 is 8 with one more word.
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 4, 5, None, 6, 7, 8, 10, 11], key=repr)


def test_drop_near_copies_leaves_clean_texts_of_null_and_repeated_ids(spark):
    text = lambda name, n=40: " ".join(f"{name}{i}" for i in range(n))
    clean = [(None, text("a")), (None, text("b")), (None, text("c")), (20, text("d")), (20, text("e")), (20, text("f"))]
    # Near copies: all of null ids, two texts of the smallest id and one of another, one null id beside a known one.
    near = [[(None, text("g")), (None, text("g", 41))], [(30, text("h")), (30, text("h", 41)), (31, text("h", 42))],
            [(None, text("i")), (40, text("i", 41))]]
    rows = clean + [r for group in near for r in group]
    kept = [(r.doc_id, r.text) for r in stages.drop_near_copies(spark, documents(spark, [(*r, "en", "a") for r in rows]), "").collect()]
    assert sorted((r for r in kept if r in clean), key=repr) == sorted(clean, key=repr)
    assert len(kept) == len(clean) + 3
    assert [sorted({i for i, t in kept if (i, t) in group}, key=repr) for group in near] == [[None], [30], [40]]


def test_mix_repeats_and_cuts(spark):
    rows = [(i, f" a{i}\tb c\nd{i} " * 30, "en", "big") for i in range(40)] + [(100, "p  q\nr", "en", "tiny"), (101, "x y", "en", None)]
    docs = documents(spark, rows)
    got = stages.mix_sources(spark, docs, "").collect()
    texts = {i: t for i, t, *_ in rows}
    words = sum(len(r.text.split()) for r in got)
    assert abs(words - sum(len(t.split()) for t in texts.values())) <= 96
    for r in got:
        assert texts[r.doc_id].startswith(r.text) and r.text.strip()
        assert r.n_chars == len(r.text)
        assert all(r[c] == "x" for c in CLASHING)


def test_runs_through(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    used = {}
    for r in pieces:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
    assert sum(end for end in (sum(n for _, n in p) for p in used.values())) > 0.95 * 1024 * len(used)


def test_empty_documents_run_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
