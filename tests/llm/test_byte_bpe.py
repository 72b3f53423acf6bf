import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from emberlog.llm import byte_bpe as b
from tests.llm.conftest import documents

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
PIECES = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", " ", "　", "é", "漢", "🙂", "1", "٣", "!", "?", "x", "'s", "'re",
          "'ll", "\x1c", "Ⅷ", "½", "a", "word", "R", "E", "́", "\x00"]


def library(path):
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    return b.Encoder(request.param), b.Decoder(request.param), library(request.param)


def check(pair, texts):
    encoder, decoder, known = pair
    raw = [t.encode() for t in texts]
    ids, firsts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for i, t in enumerate(texts):
        own = ids[firsts[i]:firsts[i + 1]]
        assert own.tolist() == known.encode_ordinary(t)
        assert decoder.decode(own).tobytes() == raw[i]


@pytest.mark.parametrize("step", [1 << 20, 7, 13])
def test_ids_equal_the_library(pair, monkeypatch, step):
    """Texts one behind the other, cut into steps of any size."""
    monkeypatch.setattr(b, "STEP", step)
    rng = random.Random(step)
    for _ in range(30):
        check(pair, ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(100 if step > 100 else 20)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=6))
def test_any_text(texts):
    check(_first_pair(), texts)


def _first_pair(known={}):
    if not known:
        known["pair"] = b.Encoder(FILES[0]), b.Decoder(FILES[0]), library(FILES[0])
    return known["pair"]


def test_long_slices_and_full_tables(pair, monkeypatch):
    monkeypatch.setattr(b, "REMEMBERED", 50)
    rng = random.Random(9)
    points = [chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20_000)]
    check(pair, ["a" * 3000 + " " * 2000 + "b", " ".join(f"word{i}'s" for i in range(5000)), "".join(points), "ab" * 4000, "\n" * 500])


def test_scans_equal_a_plain_walk():
    rng = np.random.default_rng(3)
    table = b._functions()
    for n in (0, 1, 5, 255, 256, 257, 5000):
        symbols = rng.integers(0, 2 * b.OPENING, n).astype(np.uint8)
        state, expected = 3, []
        for s in symbols:
            expected.append(state)
            state = table[s, state]
        assert b.scan(symbols, 3).tolist() == [*expected, state]


def test_composition_is_the_functions():
    f = b.FUNCTIONS
    for x in range(len(f)):
        for y in range(len(f)):
            assert (f[b.THEN[x, y]] == f[y][f[x]]).all()


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(b, "mix", lambda x: x & np.uint64(3))
    check(_first_pair(), ["one two three four five six two one", "x\x00 x"])


def test_rows(spark, odd_rows):
    known = library(FILES[0])
    docs = documents(spark, odd_rows)
    got = sorted(map(tuple, b.digests(docs, FILES[0]).collect()), key=repr)
    expected = []
    for doc, text, *_ in odd_rows:
        ids = known.encode_ordinary(text or "")
        expected.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    for r, text in ((r, dict((i, t) for i, t, *_ in odd_rows)[r.doc_id]) for r in b.decode(b.encode(docs, FILES[0]), FILES[0]).filter("doc_id in (6, 7, 8)").collect()):
        raw = text.encode()
        assert bytes(r.decoded) == raw
        # An id's offset is where its token stands in the text.
        for a, z, i in list(zip(r.starts, [*r.starts[1:], len(raw)], r.ids))[:500]:
            assert raw[a:z] == known.decode_single_token_bytes(i)
    assert b.digests(documents(spark, []), FILES[0]).count() == 0


def test_bad_input(spark, tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no token"):
        b.ranks_of(str(path))
    with pytest.raises(ValueError, match="doesn't have"):
        b.Decoder(FILES[0]).decode(np.array([10**6]))
