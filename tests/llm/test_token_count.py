import random

import public_tokenizers
import pytest
import sentencepiece

from emberlog.llm import token_count as m
from tests.llm.conftest import documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_agree_with_the_library(library, monkeypatch):
    monkeypatch.setattr(m, "REMEMBERED", 100)
    monkeypatch.setattr(m, "PART_CHARS", 25)
    rng = random.Random(3)
    odd = "ab the▁  \n\t01é漢ß🙂\x00<0x41></s>   '.,-()"
    count = m.counter(m.ranks_of(PATH))
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(60)))
        assert count(text) == len(library.encode(text, num_threads=1)), repr(text)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F6FF)])) for _ in range(30))
        assert count(text) == len(library.encode(text, num_threads=1)), repr(text)


def test_rows(spark, odd_rows, library):
    got = m.token_counts(documents(spark, odd_rows), PATH).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", num_threads=1))) for i, t, *_ in odd_rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert any(r.over_limit for r in got)


def test_empty_table(spark):
    got = m.token_counts(documents(spark, []), PATH)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got.count() == 0
