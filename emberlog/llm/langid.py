"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text is the vector of its hashed byte trigrams, sublinear in frequency, weighted by inverse document
frequency and normalised. Each language has several centroids, found by spherical k-means on a bounded sample of its
texts; document frequencies come from all learning texts. A text gets the language of the centroid of
highest cosine. It is rejected when that centroid is too far away, measured by how far its own learning texts are, or when
it has no letter.

Scoring is one pass without a shuffle; long texts go through in windows, whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import meet, slices, utf8
from emberlog.session import settled

#: Length of a vector.
SIZE = 1 << 13
#: Centroids per language, and rounds of clustering.
CENTROIDS, ROUNDS = 4, 8
#: Texts per language that the centroids are fitted on, and the most that one task can hold.
SAMPLE_PER_LANGUAGE, LARGEST_SAMPLE = 600, 1000
#: Bits of a row's hash by which rows are counted before any is ranked.
PREFIX_BITS = 14
#: Languages up to which the bounds of their samples are sent to every task; more of them are joined by a shuffle.
SENT_LANGUAGES = 10_000
#: A text whose best cosine is below its centroid's bound is rejected. The bound is SLACK times the QUANTILE of the cosines
#: of the learning texts that are nearest to the centroid, in their own language and of like length (cosines grow with
#: it): lengths are classes by the power of two of the number of trigrams, from SHORTEST to LONGEST.
QUANTILE, SLACK, SHORTEST, LONGEST = 0.005, 0.5, 5, 9
#: Of fewer texts of a class the language's stand for the centroid's, and of fewer of those the least bound of any language is
#: taken; without any, MIN_COSINE. Texts with fewer trigrams than MIN_GRAMS are too short to be told to be far from everything.
LEAST_TEXTS, MIN_COSINE, MIN_GRAMS = 20, 0.03, 60
#: Steps of the cosines that are counted for the quantiles.
STEPS = 200
UNKNOWN = "und"
WINDOW = 1 << 20
_ROWS = 64

_GRAM_BYTE = np.arange(256, dtype=np.uint32)
_GRAM_BYTE[ord("A"):ord("Z") + 1] += 32
_GRAM_BYTE[[b for b in range(128) if not chr(b).isalpha()]] = 32
_LETTER = regex.compile(r"\p{L}")


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams, one line per text. Trigrams have two letters at least; all that is ASCII and no
    letter counts as a space."""
    rows = len(offsets) - 1
    counts = np.zeros(rows * SIZE)
    for a in range(0, len(data), WINDOW):
        part = _GRAM_BYTE[data[a:a + WINDOW + 2]]
        if len(part) < 3:
            break
        row = np.searchsorted(offsets, np.arange(a, a + len(part)), side="right") - 1 if rows > 1 else np.zeros(len(part), np.int64)
        letter = part != 32
        full = (row[2:] == row[:-2]) & (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2)
        gram = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        slot = (gram[full] * np.uint32(2654435761)) >> np.uint32(32 - 13)
        counts += np.bincount(row[:-2][full] * SIZE + slot, minlength=rows * SIZE)
    return counts.reshape(rows, SIZE)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF lines; a text without trigrams is all zeros."""
    out = (np.log1p(counts) * idf).astype(np.float32)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, _ROWS):
        for piece in slices(batch.slice(start, _ROWS), column, WINDOW):
            yield piece, gram_counts(*utf8(piece.column(column)))


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(np.int64), SHORTEST, LONGEST) - SHORTEST


def bounds_from(found: np.ndarray, languages: list[str]) -> np.ndarray:
    """Bounds per centroid and class of length from the numbers of learning texts per centroid, class and step of cosine."""
    lines = {name: i for i, name in enumerate(dict.fromkeys(languages))}
    of_language = np.zeros((len(lines), *found.shape[1:]), dtype=found.dtype)
    own = np.array([lines[name] for name in languages])
    np.add.at(of_language, own, found)
    used = np.where((found.sum(axis=2) >= LEAST_TEXTS)[:, :, None], found, of_language[own])
    total = used.sum(axis=2)
    step = (used.cumsum(axis=2) > np.floor(QUANTILE * total)[:, :, None]).argmax(axis=2)
    bounds = np.where(total >= LEAST_TEXTS, SLACK * step / STEPS, np.inf)
    bounds = np.where(np.isinf(bounds), bounds.min(axis=0), bounds)
    return np.where(np.isinf(bounds), np.nan, bounds)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; fewer centroids when texts are few or alike."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    nearest = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)) and nearest.min() < 0.999:
        seeds.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[seeds[-1]])
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        means = [x[own == c].mean(axis=0) for c in range(len(centres)) if (own == c).any()]
        centres = np.stack([m / (np.linalg.norm(m) or 1) for m in means])
    return centres


class Centroids:
    """A fitted model: a few centroids per language; its size depends on the number of languages only.

    `bounds` has a line per centroid with the least cosine per class of length, NaN where no language has enough texts.
    """

    def __init__(self, idf: np.ndarray, languages: list[str], centres: np.ndarray, bounds: np.ndarray | None = None) -> None:
        self.idf, self.languages, self.centres = idf, languages, centres
        self.bounds = np.full((len(centres), LONGEST - SHORTEST + 1), np.nan) if bounds is None else bounds

    def far(self, counts: np.ndarray, best: np.ndarray, cosine: np.ndarray, min_cosine: float) -> np.ndarray:
        """Is a text beyond the bound of its centroid? `min_cosine` is the bound where none was learned."""
        bound = self.bounds[best, length_class(counts)]
        return (cosine < np.where(np.isnan(bound), min_cosine, bound)) & (counts.sum(axis=1) >= MIN_GRAMS)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosine = vectors(counts, self.idf) @ self.centres.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Centroids | None:
    """Learn from rows with a text and a language; None if there are none.

    Every language that occurs is learned. The sample of a language is its `per_language` rows of smallest seeded hash of
    id and text; copies of a row count once, so repeated and null ids neither widen nor fill it.
    """
    if not 1 <= per_language <= LARGEST_SAMPLE:
        raise ValueError(f"per_language must be from 1 to {LARGEST_SAMPLE}: the sample of a language is held by one task")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(
        "lang is not null and text is not null")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(SIZE, dtype=np.int64), 0
        for batch in batches:
            for _, counts in _rows(batch, 0):
                seen += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, SIZE)), pa.array(np.append(n, seen))], names=["slot", "n"])

    df = rows.select("text").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    found = df.set_index("slot")["n"].reindex(range(-1, SIZE), fill_value=0).to_numpy()
    if not found[0]:
        return None
    idf = np.log((1 + found[0]) / (1 + found[1:])) + 0.05

    # Rows are counted by the upper bits of their hash first, at most 2**PREFIX_BITS counts per language; only those
    # up to the prefix that fills the sample are ranked.
    ordered = rows.withColumn("_order", F.xxhash64(F.lit("langid"), "doc_id", "text")).withColumn("_prefix", F.shiftright("_order", 64 - PREFIX_BITS))
    counted = ordered.groupBy("lang", "_prefix").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("lang").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    needed = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < per_language)
    cut = settled(needed.groupBy("lang").agg(F.max("_prefix").alias("_last")), "cut")
    if cut.count() <= SENT_LANGUAGES:
        # One row per language: with the join by broadcast, no text moves but the sample's.
        bounded = ordered.join(F.broadcast(cut), "lang")
    else:
        sizes = rows.groupBy("lang").agg(F.count("*").alias("_size"))
        bounded = meet(ordered, settled(cut.join(sizes, "lang"), "cut"), ["lang"], "_size")
    once = bounded.filter("_prefix <= _last").select("lang", "_order", "text").dropDuplicates(["lang", "_order"])
    sample = (once.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order")))
              .filter(F.col("_rank") <= per_language).select("lang", "text"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, counts in _rows(batch, 1):
                lines = vectors(counts, idf)
                slots = [np.flatnonzero(v) for v in lines]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([s.astype("<u2").tobytes() for s in slots], pa.binary()),
                     pa.array([v[s].astype("<f4").tobytes() for v, s in zip(lines, slots)], pa.binary())],
                    names=["lang", "slots", "weights"])

    def centroids(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(group), SIZE), dtype=np.float32)
        for line, slots, weights in zip(x, group["slots"], group["weights"]):
            line[np.frombuffer(slots, "<u2")] = np.frombuffer(weights, "<f4")
        # The order of arrival must not matter.
        x = x[np.lexsort((x.argmax(axis=1), x.sum(axis=1)))]
        centres = cluster(x)
        return pd.DataFrame({"lang": [key[0]] * len(centres), "centre": [c.astype("<f4").tobytes() for c in centres]})

    # Texts without a trigram say nothing.
    fitted = (sample.mapInArrow(sparse, "lang string, slots binary, weights binary").filter(F.octet_length("slots") > 0).groupBy("lang")
              .applyInPandas(centroids, "lang string, centre binary").toPandas())
    if fitted.empty:
        return None
    fitted = fitted.sort_values(["lang", "centre"])
    model = Centroids(idf, fitted["lang"].tolist(), np.stack([np.frombuffer(c, "<f4") for c in fitted["centre"]]))
    model.bounds = _bounds(rows.select("lang", "text"), model)
    return model


def _bounds(rows: DataFrame, model: Centroids) -> np.ndarray:
    """The bounds of a model from all learning texts, in one pass that shuffles counts only."""
    shape = (len(model.centres), LONGEST - SHORTEST + 1, STEPS)

    def cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = np.array(model.languages, dtype=object), Counter()
        for batch in batches:
            for piece, counts in _rows(batch, 1):
                best, cosine = model.nearest(counts)
                own = (names[best] == np.array(piece.column(0).to_pylist(), dtype=object)) & (counts.sum(axis=1) >= MIN_GRAMS)
                step = np.minimum((cosine * STEPS).astype(np.int64), STEPS - 1)
                seen.update(np.ravel_multi_index((best, length_class(counts), step), shape)[own].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["cell", "n"])

    cells = rows.mapInArrow(cosines, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    found = np.zeros(np.prod(shape), dtype=np.int64)
    found[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return bounds_from(found.reshape(shape), model.languages)


def identify(docs: DataFrame, model: Centroids | None, carry: list[str], text_col: str = "text",
             min_cosine: float = MIN_COSINE) -> DataFrame:
    """The columns `carry` and lang_pred, score, rejected of every row.

    Texts that are null or without a letter are `und` with score 0 and are rejected; so is every text when nothing
    could be learned. Any other text gets the nearest learned language, with the cosine as score, and is
    rejected if it has MIN_GRAMS trigrams and the cosine is below the centroid's bound for its length, or below `min_cosine`
    where no language has enough texts for one. Equal cosines go to the first language
    in order. Repeated rows are independent; an empty table gives an empty result.
    """
    schema = docs.select(*carry).schema.simpleString()[len("struct<"):-1]
    n = len(carry)
    # A text that is carried is not sent twice.
    at = carry.index(text_col) if text_col in carry else n
    sent = docs.select(*carry) if at < n else docs.select(*carry, F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, counts in _rows(batch, at):
                lettered = np.array([t is not None and _LETTER.search(t) is not None for t in (v.as_py() for v in piece.column(at))])
                if model is None:
                    score, names = np.zeros(len(counts)), np.full(len(counts), UNKNOWN, dtype=object)
                    far = np.ones(len(counts), dtype=bool)
                else:
                    best, score = model.nearest(counts)
                    names = np.where(lettered, np.array(model.languages, dtype=object)[best], UNKNOWN)
                    far = model.far(counts, best, score, min_cosine)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n], pa.array(names, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(~lettered | far)],
                    names=[*carry, "lang_pred", "score", "rejected"])

    return sent.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")
