import random
import zlib

import numpy as np
import pyarrow as pa

from emberlog.llm import toxicity as m
from emberlog.llm.common import table, utf8
from tests.llm.conftest import documents
from tests.oracle import TESTDATA


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_learns_pairs(monkeypatch):
    # Neither word alone is toxic, both together are: no linear model can tell.
    rng = random.Random(1)
    texts, toxic = [], []
    for i in range(1200):
        words = [f"w{rng.randrange(30)}" for _ in range(6)] + ["insult"] * (i % 2) + ["group"] * (i // 2 % 2)
        texts.append(" ".join(words))
        toxic.append(float(i % 2 and i // 2 % 2))
    monkeypatch.setattr(m, "LASSO", 0.0)
    monkeypatch.setattr(m, "EPOCHS", 20)
    monkeypatch.setattr(m, "FACTOR_RATE", 0.2)
    f = m.features(*utf8(pa.array(texts)))
    model = m.train(*f, np.array(toxic))
    assert ((model.raw(*f) > 0) == (np.array(toxic) > 0)).mean() > 0.97


def test_scores_equal_the_double_loop_over_pairs():
    rng = np.random.default_rng(3)
    machine = m.Machine(-0.7, rng.normal(size=1 << m.SLOT_BITS), rng.normal(size=(1 << m.SLOT_BITS, m.FACTORS)))
    texts = ["one two three two", "", "insult the group", "x", "a b c d e f g a a", " \t "]
    slots, values, sizes = m.features(*utf8(pa.array(texts)))
    got, at = machine.raw(slots, values, sizes), 0
    for text, raw, size in zip(texts, got, sizes):
        terms = list(zip(slots[at:at + size].tolist(), values[at:at + size].astype(float).tolist()))
        at += size
        want = machine.bias + sum(machine.weights[s] * x for s, x in terms)
        want += sum(x * y * sum(machine.factors[s][f] * machine.factors[t][f] for f in range(m.FACTORS))
                    for i, (s, x) in enumerate(terms) for t, y in terms[i + 1:])
        assert abs(raw - want) < 1e-5 * max(1.0, abs(want)), text
    assert at == len(slots) and got[1] == got[5] == machine.bias


def test_training_follows_the_gradient_of_the_loss():
    """Training lowers the weighted logistic loss, and weights stand against its numeric gradient at the start."""
    texts = [f"insult w{i % 7} group" if i % 3 == 0 else f"w{i % 5} w{i % 11} calm" for i in range(63)]
    labels = np.array([float(i % 3 == 0) for i in range(63)])
    f = m.features(*utf8(pa.array(texts)))
    model = m.train(*f, labels)

    def loss(machine):
        raw = machine.raw(*f)
        return float((np.where(labels > 0, m.TOXIC_WEIGHT, 1.0) * (np.logaddexp(0, raw) - labels * raw)).sum())

    untrained = m.Machine(float(np.log(1 / 2)), np.zeros(1 << m.SLOT_BITS), np.zeros((1 << m.SLOT_BITS, m.FACTORS)))
    assert loss(model) < 0.5 * loss(untrained)
    for slot in np.flatnonzero(model.weights)[:10]:
        probe = [m.Machine(untrained.bias, untrained.weights.copy(), untrained.factors) for _ in range(2)]
        probe[0].weights[slot], probe[1].weights[slot] = -1e-4, 1e-4
        slope = (loss(probe[1]) - loss(probe[0])) / 2e-4
        # Common terms that speak for neither side have a flat loss.
        assert slope * model.weights[slot] < 0 or abs(slope) < 2


def test_held_out_accuracy(spark):
    sf = f"{TESTDATA}/sf0.1"
    docs, marks = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = {i for i in range(100_000) if zlib.crc32(str(i).encode()) % 5 == 0}
    truth = {r.doc_id: r.toxic for r in marks.collect() if r.doc_id in held}
    model = m.fit(docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"), marks)
    got = {r.doc_id: r.predicted for r in m.score(docs, model, ["doc_id"]).collect() if r.doc_id in truth}
    right = sum(got[i] == truth[i] for i in truth) / len(truth)
    found = sum(got[i] for i in truth if truth[i]) / sum(truth.values())
    assert right > 0.97 and found > 0.8


def test_odd_rows(spark, odd_rows):
    docs = documents(spark, odd_rows)
    model = m.fit(docs, labels(spark, [(1, 1, 1), (2, 0, 0), (3, 0, 1), (4, 0, None), (99, 0, 1), (None, 0, 1)]))
    got = m.score(docs, model, ["doc_id"]).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_no_labels_and_empty_table(spark, odd_rows):
    assert m.fit(documents(spark, odd_rows), labels(spark, [])) is None
    assert {r.score for r in m.score(documents(spark, odd_rows), None, ["doc_id"]).collect()} == {0.0}
    assert m.score(documents(spark, []), None, ["doc_id"]).count() == 0


def test_pair_sums_against_the_double_loop():
    rng = np.random.default_rng(6)
    n, factors = 1 << m.SLOT_BITS, m.FACTORS
    model = m.Machine(0.3, rng.normal(size=n), rng.normal(size=(n, factors)))
    slots, values, sizes = m.features(*utf8(pa.array(["you insult that group", "", "one", "a b a b a c " * 5])))
    expected, at = [], 0
    for size in sizes:
        s, x = slots[at:at + size], values[at:at + size].astype(float)
        at += size
        pairs = sum(model.factors[s[i]] @ model.factors[s[j]] * x[i] * x[j] for i in range(size) for j in range(i + 1, size))
        expected.append(model.bias + float(model.weights[s] @ x) + pairs)
    assert np.allclose(model.raw(slots, values, sizes), expected, atol=1e-4)


def test_a_repeated_id_does_not_widen_the_sample(spark):
    rows = [(7, f"text number {i} of many", "en", "a") for i in range(300)] + [(i, f"other {i}", "en", "a") for i in range(100, 150)]
    marks = labels(spark, [(7, 0, 1), *[(i, 0, 0) for i in range(100, 150)]])
    model = m.fit(documents(spark, rows), marks, sample=40)
    # In whatever order the rows come, the same 40 of them are learned from.
    again = m.fit(documents(spark, rows).repartition(5), marks, sample=40)
    assert model.bias == again.bias and np.array_equal(model.weights, again.weights)
