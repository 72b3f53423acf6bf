import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from emberlog.llm import packing as m
from tests.llm.conftest import documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_agree_with_the_library(library, monkeypatch):
    rng = random.Random(3)
    odd = "ab the  \n\t01é漢ß🙂\x00½²Ⅷ   '.,-()\x85\xa0'll's"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += ["a<|endoftext|>b", " <|endoftext|> x", "<|endoftext|>"]
    encode = m.encoder(PATH)
    assert [encode(t).tolist() for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(m.text_parts, "__defaults__", (20,))
    long = " ".join(texts)
    assert encode(long).tolist() == library.encode(long, add_special_tokens=False).ids


def test_pieces(spark, odd_rows, library):
    got = m.pack(documents(spark, odd_rows), PATH).collect()
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in odd_rows]
    # Rows that repeat an id have equal texts here, but for the null ids; a crc tells all pieces apart.
    left = sorted(((i, len(x)) for (i, *_), x in zip(odd_rows, ids)), key=repr)
    whole = {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for (i, n), pieces in whole.items():
        assert sum(p.length for p in pieces) == n * left.count((i, n))
    for (i, _, *_), x in zip(odd_rows, ids):
        for p in whole[(i, len(x))]:
            if i is not None:
                assert zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= m.CAPACITY
    partitions = documents(spark, odd_rows).rdd.getNumPartitions()
    assert len(sequences) * m.CAPACITY - sum(map(len, ids)) < m.CAPACITY * partitions


def test_place_balances_cost():
    rng = random.Random(5)
    lengths = [rng.choice([1, 30, 400, 900, 1024, 2500]) for _ in range(300)]
    pieces = list(m.place(lengths, 1024))
    total = [0] * len(lengths)
    cost, used = {}, {}
    for doc, start, n, sequence, offset in pieces:
        assert start == total[doc] and offset == used.get(sequence, 0)
        total[doc] += n
        used[sequence] = offset + n
        cost[sequence] = cost.get(sequence, 0) + m.cost(n)
    assert total == lengths
    assert len(used) == -(-sum(n % 1024 for n in lengths) // 1024) + sum(n // 1024 for n in lengths)
    # Sequences of several pieces cost about the same.
    shared = [c for s, c in cost.items() if sum(p[3] == s for p in pieces) > 1]
    assert max(shared) < 1.2 * min(sorted(shared)[1:])


def test_empty_table(spark):
    assert m.pack(documents(spark, []), PATH).count() == 0
