import collections
import math
import re

import pytest

from emberlog.llm import lm as m
from tests.llm.conftest import documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END, START = "\0end", "\0start"


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [END]


class Brute:
    def __init__(self, texts):
        texts = [tokens(t) for t in texts]
        self.c = collections.Counter(w for t in texts for w in t)
        self.pairs = collections.Counter(p for t in texts for p in zip([START, *t], t))
        self.before = collections.Counter(w for _, w in self.pairs)
        self.after = collections.defaultdict(lambda: [0, 0, 0, 0])
        for (u, _), n in self.pairs.items():
            self.after[u][0] += n
            self.after[u][min(n, 3)] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.d1, self.d2 = (m.discounts([sum(x == k for x in table.values()) for k in (1, 2, 3, 4)]) for table in (self.before, self.pairs))

    def low(self, w):
        left = sum(self.d1[min(x, 3)] for x in self.before.values()) / len(self.pairs)
        x = self.before.get(w, 0)
        return (x - self.d1[min(x, 3)]) / len(self.pairs) + left / (self.v + 1)

    def p(self, u, w):
        if u not in self.after:
            return self.low(w)
        total, *seen = self.after[u]
        n = self.pairs.get((u, w), 0)
        return (n - self.d2[min(n, 3)]) / total + sum(d * s for d, s in zip(self.d2[1:], seen)) / total * self.low(w)

    def score(self, text):
        t = tokens(text)
        return sum(math.log10(self.p(u, w)) for u, w in zip([START, *t], t))

    def base(self, text):
        return sum(math.log10((self.c.get(w, 0) + 1) / (self.n + self.v + 1)) for w in tokens(text))


@pytest.fixture(scope="module")
def rows(odd_rows):
    return [r for r in odd_rows if r[0] not in (8, 9)] + [(20 + i, f"a b a c b{i % 3} the the end {i % 2}", "en", "a") for i in range(12)]


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, monkeypatch, rows, small):
    if small:
        # Many shards, tallies sent early, and most contexts hot.
        monkeypatch.setattr(m, "SHARD_BYTES", 64)
        monkeypatch.setattr(m, "HELD", 20)
        monkeypatch.setattr(m, "HOT_SHARE", 30)
    train, brute = rows[::2], Brute([r[1] for r in rows[::2]])
    got = m.score(documents(spark, rows), m.fit(documents(spark, train)), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(tokens(r.text))
        assert r.n_known == sum(w in brute.c for w in tokens(r.text))
        assert r.train_tokens == brute.n
        assert r.score == pytest.approx(brute.score(r.text), abs=1e-9)
        assert r.base_score == pytest.approx(brute.base(r.text), abs=1e-9)
    assert sum(brute.p("the", w) for w in [*brute.c, "\0unknown"]) == pytest.approx(1)


def test_no_training_texts(spark, rows):
    got = m.score(documents(spark, rows), m.fit(documents(spark, [])), ["doc_id"]).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


def test_empty_table(spark, rows):
    assert m.score(documents(spark, []), m.fit(documents(spark, rows)), ["doc_id"]).count() == 0
