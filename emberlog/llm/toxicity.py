"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text (A-Z lower-cased) and their first few bytes, so that endings and
punctuation do not hide a stem, hashed into a table. A text's score adds a weight per term and, for every two of its terms,
the product of their factor vectors: a pair such as an insult and the mention of a group can count for
more than either alone, which a linear model cannot say. The pair sum costs only one pass over the terms.

The model is fitted in one task on a bounded sample of labelled texts and has a fixed size. Scoring is one pass over
the texts, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import hash_words, slices, utf8

#: Slots of hashed terms (a power of two), factors per term, and the lengths of the stems in bytes.
SLOT_BITS, FACTORS, STEMS = 17, 4, (5, 6, 8)
#: Bound of the labelled texts that the model is fitted on.
SAMPLE = 10_000
#: Training: passes, texts per step, step sizes of weights and factors, decay, and the pull of weights to zero.
EPOCHS, BATCH, RATE, FACTOR_RATE, DECAY, LASSO = 8, 64, 1.2, 0.03, 1e-3, 0.03
#: A toxic text weighs as much as this many others.
TOXIC_WEIGHT = 4.0
#: Slots that fewer texts of the sample share are not learned.
MIN_TEXTS = 20
WINDOW = 1 << 20


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, number per text): the distinct terms of each text with sublinear, partly normalised frequencies."""
    hashes, counts = hash_words(data, offsets, STEMS)
    rows = np.tile(np.repeat(np.arange(len(counts)), counts), len(hashes))
    # A word and a stem of the same bytes are different terms.
    salt = (np.arange(len(hashes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    slots = ((hashes ^ salt) >> np.uint64(64 - SLOT_BITS)).astype(np.int64).ravel()
    both, times = np.unique(rows << SLOT_BITS | slots, return_counts=True)
    row, slot = both >> SLOT_BITS, both & ((1 << SLOT_BITS) - 1)
    sizes = np.bincount(row, minlength=len(counts))
    value = np.log1p(times)
    # Half way to unit length: a few insults must not vanish in a long text.
    norm = np.bincount(row, value * value, minlength=len(counts)) ** 0.25
    return slot.astype(np.int32), (value / np.maximum(norm, 1e-12)[row]).astype(np.float32), sizes


class Machine:
    """Weights and factors per slot."""

    def __init__(self, bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.bias, self.weights, self.factors = bias, weights, factors

    def raw(self, slots: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds per text; a text without terms has the bias."""
        out = np.full(len(sizes), self.bias)
        full = sizes > 0
        if len(slots):
            heads = (np.cumsum(sizes) - sizes)[full]
            v = self.factors[slots] * values[:, None]
            sums = np.add.reduceat(v, heads)
            pairs = 0.5 * (sums * sums - np.add.reduceat(v * v, heads)).sum(axis=1)
            out[full] += np.add.reduceat(self.weights[slots] * values, heads) + pairs
        return out


def train(slots: np.ndarray, values: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> Machine:
    """Weighted logistic loss by AdaGrad on batches in a seeded order, with weights drawn to zero."""
    rng = np.random.default_rng(11)
    n = 1 << SLOT_BITS
    rate = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    m = Machine(float(np.log(rate / (1 - rate))), np.zeros(n), rng.normal(0, 0.05, (n, FACTORS)))
    seen_w, seen_v, seen_b = np.full(n, 1e-3), np.full((n, FACTORS), 1e-3), 1e-3
    # A slot that few texts share would only be learned by heart.
    common = np.bincount(slots, minlength=n) >= MIN_TEXTS
    learned = common[slots]
    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[learned], minlength=len(sizes))
    slots, values = slots[learned], values[learned]
    m.factors[~common] = 0
    heads = np.cumsum(sizes) - sizes
    usable = np.flatnonzero(sizes > 0)
    for _ in range(EPOCHS if len(usable) else 0):
        for batch in np.array_split(rng.permutation(usable), max(1, len(usable) // BATCH)):
            size = sizes[batch]
            at = np.repeat(heads[batch] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            slot, inverse = np.unique(slots[at], return_inverse=True)
            x, doc = values[at].astype(np.float64), np.repeat(np.arange(len(batch)), size)
            start = np.cumsum(size) - size
            v = m.factors[slot][inverse] * x[:, None]
            sums = np.add.reduceat(v, start)
            raw = m.bias + np.add.reduceat(m.weights[slot][inverse] * x, start) + 0.5 * (
                sums * sums - np.add.reduceat(v * v, start)).sum(axis=1)
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]
            error = np.where(labels[batch] > 0, TOXIC_WEIGHT, 1.0) * error
            gx = error[doc] * x
            grad = np.bincount(inverse, gx, minlength=len(slot)) + DECAY * m.weights[slot]
            seen_w[slot] += grad * grad
            step = RATE / np.sqrt(seen_w[slot])
            moved = m.weights[slot] - step * grad
            m.weights[slot] = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
            push = gx[:, None] * (sums[doc] - v)
            for f in range(FACTORS):
                grad = np.bincount(inverse, push[:, f], minlength=len(slot)) + DECAY * m.factors[slot, f]
                seen_v[slot, f] += grad * grad
                m.factors[slot, f] -= FACTOR_RATE * grad / np.sqrt(seen_v[slot, f])
            seen_b += error.mean() ** 2
            m.bias -= 0.05 * error.mean() / np.sqrt(seen_b)
    return Machine(m.bias, m.weights.astype(np.float32), m.factors.astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Machine | None:
    """Learn from the documents that have a label; None if there are none.

    The sample is the rows of the `sample` labelled ids of smallest seeded hash, and no more than `sample` of them where ids
    repeat; an id with several labels counts as toxic if one of them says so.
    """
    marked = labels.filter(f"{label_col} is not null and {id_col} is not null").groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("toxic"))
    known = docs.select(F.col(id_col).alias("doc_id"))
    order = F.xxhash64(F.lit("toxicity"), "doc_id")
    chosen = marked.join(known, "doc_id", "left_semi").withColumn("order", order).orderBy("order", "doc_id").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 2, WINDOW):
                slots, values, sizes = features(*utf8(piece.column(2)))
                cuts = np.cumsum(sizes)[:-1]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([s.tobytes() for s in np.split(slots, cuts)], pa.binary()),
                     pa.array([v.tobytes() for v in np.split(values, cuts)], pa.binary())], names=["order", "toxic", "slots", "values"])

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        # The order of arrival must not matter.
        group = group.sort_values(["order", "slots"], ignore_index=True)
        slots = [np.frombuffer(s, np.int32) for s in group["slots"]]
        values = np.concatenate([np.frombuffer(v, np.float32) for v in group["values"]])
        sizes = np.array([len(s) for s in slots])
        m = train(np.concatenate(slots), values, sizes, group["toxic"].to_numpy(dtype=float))
        return pd.DataFrame({"bias": [m.bias], "weights": [m.weights.tobytes()], "factors": [m.factors.tobytes()]})

    fitted = (texts.select("order", F.col("toxic").cast("double").alias("toxic"), "text")
              .mapInArrow(lines, "order long, toxic double, slots binary, values binary")
              .orderBy("order", "slots", "values").limit(sample)
              .groupBy(F.lit(0).alias("one")).applyInPandas(learn, "bias double, weights binary, factors binary").toPandas())
    if fitted.empty:
        return None
    row = fitted.iloc[0]
    return Machine(float(row["bias"]), np.frombuffer(row["weights"], np.float32),
                   np.frombuffer(row["factors"], np.float32).reshape(-1, FACTORS))


def score(docs: DataFrame, model: Machine | None, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns `carry` and score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Null and empty texts get the score of a text without terms. Without a model every score is 0. Repeated rows and
    ids are independent; an empty table gives an empty result; other columns are not read.
    """
    schema = docs.select(*carry).schema.simpleString()[len("struct<"):-1]
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, n, WINDOW):
                if model is None:
                    p = np.zeros(piece.num_rows)
                else:
                    p = 1 / (1 + np.exp(-np.clip(model.raw(*features(*utf8(piece.column(n)))), -700, 700)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 names=[*carry, "score", "predicted"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{schema}, score double, predicted int")
