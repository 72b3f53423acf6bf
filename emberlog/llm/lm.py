"""Interpolated modified Kneser-Ney bigram model, counted in Spark and read from memory-mapped sorted arrays.

Counting. Tasks count the words of their texts, and later the pairs of neighbours, in numpy and send sorted arrays per
shard, so what is shuffled is one entry per task and distinct word or pair. One task per shard merges them
and writes its sorted arrays into the shared folder:

* a word is its 64-bit hash; shards are ranges of the hash, so the rank of a hash over all shards is the word's id;
* a pair is (id of the context, id of the word) in one 64-bit key; shards go by the context, and the pairs of
  the few contexts that hold very many words are dealt out by the whole key, so that no shard is hot;
* beside its pairs a shard keeps, per context, the number of tokens and of distinct words seen once, twice and more often;
* continuation counts (distinct contexts of a word) are summed per shard of words.

Scoring. Workers map the arrays and look up the sorted distinct words and pairs of a slice of texts, so that a lookup
mostly touches pages it has just touched. Only the discounts, the shard sizes and the statistics of the hot contexts (a
bounded number) travel through the driver. The arrays grow with the corpus; nothing is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import hash_words, mix, slices, utf8
from emberlog.llm.shared_files import SharedFiles
from emberlog.session import settled, shared_dir

#: Bytes of text per shard, about, and the largest number of shards (both powers of two).
SHARD_BYTES, MOST_SHARDS = 1 << 24, 1 << 16
#: A context is hot if one token in HOT_SHARE follows it, so there are at most that many; they are dealt out by pair.
HOT_SHARE = 4096
#: Distinct entries that a task holds before it sends them.
HELD = 4_000_000
#: Hash of the end of a text, which counts as a word.
END = np.uint64(0x454E44)
#: Largest number of words, so that two ids fit a key; the two ids behind the words are the start and unknown words.
MOST_WORDS = (1 << 32) - 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end behind each, and the number of tokens per text."""
    words, counts = hash_words(data, offsets)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def tally(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(keys) else counts


class _Tally:
    """Counts of a task, sent in sorted arrays per shard whenever many are held."""

    def __init__(self, shard_of) -> None:
        self.shard_of, self.parts, self.held = shard_of, [], 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(keys, return_counts=True)
        self.parts.append((found, counts))
        self.held += len(found)
        if self.held >= HELD:
            yield from self.send(HELD // 2)

    def send(self, unless: int = -1) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        keys, counts = tally(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))
        if len(keys) <= unless:
            self.parts, self.held = [(keys, counts)], len(keys)
            return
        self.parts, self.held = [], 0
        yield from sharded(self.shard_of(keys), keys, counts)


def sharded(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (shard, keys, counts): sorted keys and their counts in the fewest bytes."""
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    cuts = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for a, b in zip(cuts, np.append(cuts[1:], len(shard))):
        small = counts[a:b].astype(np.min_scalar_type(int(counts[a:b].max())))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(shard[a])], pa.int32()), pa.array([keys[a:b].tobytes()], pa.binary()), pa.array([small.tobytes()], pa.binary())],
            names=["shard", "keys", "counts"])


PARTS = "shard int, keys binary, counts binary"


def _joined(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    keys = [np.frombuffer(k, np.uint64) for k in group["keys"]]
    counts = [np.frombuffer(c, f"u{len(c) // len(k)}").astype(np.int64) for c, k in zip(group["counts"], keys)]
    return tally(np.concatenate(keys), np.concatenate(counts))


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of the counts 0, 1, 2 and 3 or more from the numbers of entries with count 1 to 4.

    Where a corpus is too small for the estimate, half of the count's step is taken off.
    """
    plain = [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    out = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else plain[k - 1] for k in (1, 2, 3)]
    return np.array([0.0, *[d if 0 < d < k else plain[k - 1] for k, d in zip((1, 2, 3), out)]])


class Model:
    """What is needed to read the arrays: sizes and statistics of bounded size."""

    def __init__(self, folder: str, shards: int) -> None:
        self.folder, self.shards = folder, shards
        self.bits = shards.bit_length() - 1

    def word_shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(hashes), np.uint64)).astype(np.int64)

    def pair_shard(self, keys: np.ndarray) -> np.ndarray:
        context = keys >> np.uint64(32)
        hot = np.isin(context, self.hot)
        return (mix(np.where(hot, keys, context)) % np.uint64(self.shards)).astype(np.int64)

    def set_words(self, sizes: np.ndarray, total: int, top: pd.DataFrame) -> None:
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.words, self.tokens = int(self.offsets[-1]), total
        if self.words > MOST_WORDS:
            raise ValueError("too many distinct words for the keys of pairs")
        self.start, self.unknown = self.words, self.words + 1
        # The start of a text precedes as many words as there are texts, so it is dealt out as well.
        self.hot = np.sort(np.append(self.offsets[top["shard"]] + top["at"].to_numpy(np.int64), self.start)).astype(np.uint64)

    def set_pairs(self, stats: dict[int, np.ndarray], hot: pd.DataFrame, before: pd.Series) -> None:
        self.widths = {s: int(x[0]) for s, x in stats.items()}
        n2 = sum((x[1:] for x in stats.values()), np.zeros(4, np.int64))
        self.d2 = discounts(n2.tolist())
        self.hot_contexts = np.zeros((len(self.hot), 4), dtype=np.int64)
        for ids, lines in zip(hot["keys"], hot["counts"]):
            at = np.searchsorted(self.hot, np.frombuffer(ids, np.uint64))
            self.hot_contexts[at] += np.frombuffer(lines, np.int64).reshape(-1, 4)
        self.pairs = int(before["pairs"])
        n1 = [int(before[f"n{k}"]) for k in (1, 2, 3, 4)]
        self.d1 = discounts(n1)
        # What the discounts of continuation counts leave for all words alike, unknown ones included.
        taken = self.d1[1] * n1[0] + self.d1[2] * n1[1] + self.d1[3] * (self.words - n1[0] - n1[1])
        self.left1 = taken / self.pairs if self.pairs else 1.0


class Reader:
    """The arrays of a model, mapped when first needed."""

    def __init__(self, model: Model) -> None:
        self.model, self.files, self.mapped = model, SharedFiles(model.folder), {}

    def array(self, name: str, dtype: str) -> np.ndarray:
        if name not in self.mapped:
            self.mapped[name] = self.files.read(name, dtype)
        return self.mapped[name]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        m = self.model
        out = np.full(len(hashes), m.unknown, dtype=np.uint64)
        cuts = np.searchsorted(m.word_shard(hashes), np.arange(m.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            part = hashes[cuts[s]:cuts[s + 1]]
            if m.offsets[s + 1] > m.offsets[s]:
                known = self.array(f"words-{s}", "u8")
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[cuts[s]:cuts[s + 1]] = np.where(known[at] == part, at + m.offsets[s], m.unknown).astype(np.uint64)
        return out

    def per_word(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of an array that runs along the words, for sorted distinct ids; 0 for others."""
        m = self.model
        out = np.zeros(len(ids), dtype=np.int64)
        cuts = np.searchsorted(ids, m.offsets.astype(np.uint64))
        # The ids behind the last shard are no words.
        for s in np.flatnonzero(np.diff(cuts)):
            out[cuts[s]:cuts[s + 1]] = self.array(f"{name}-{s}", "i8")[(ids[cuts[s]:cuts[s + 1]] - np.uint64(m.offsets[s])).astype(np.int64)]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(keys), dtype=np.int64)
        for s, line in self._by_shard(keys):
            if s in self.model.widths:
                known, part = self.array(f"pairs-{s}", "u8"), keys[line]
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[line] = np.where(known[at] == part, self.array(f"times-{s}", f"u{self.model.widths[s]}")[at], 0)
        return out

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        """Lines (tokens, words seen once, twice, more often) of sorted distinct contexts; zeros for unseen ones."""
        out = np.zeros((len(ids), 4), dtype=np.int64)
        for s, line in self._by_shard(ids << np.uint64(32)):
            known, part = self.array(f"contexts-{s}", "u8") if s in self.model.widths else (), ids[line]
            if len(known):
                at = np.minimum(np.searchsorted(known, part), len(known) - 1)
                out[line] = np.where((known[at] == part)[:, None], self.array(f"following-{s}", "i8").reshape(-1, 4)[at], 0)
        hot, at = self.model.hot_contexts, np.searchsorted(self.model.hot, ids)
        found = self.model.hot[np.minimum(at, len(self.model.hot) - 1)] == ids
        out[found] = hot[at[found]]
        return out

    def _by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = self.model.pair_shard(keys)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            yield int(s), order[cuts[s]:cuts[s + 1]]

    def token_ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = tokens(data, offsets)
        distinct, inverse = np.unique(hashes, return_inverse=True)
        return self.ids(distinct)[inverse], counts

    def pair_keys(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        context = np.empty_like(ids)
        context[1:] = ids[:-1]
        context[np.cumsum(counts) - counts] = self.model.start
        return context << np.uint64(32) | ids


def fit(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the texts and write the model's arrays into the shared folder; null counts as empty."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    shards = min(1 << max(0, -(-size // SHARD_BYTES) - 1).bit_length(), MOST_SHARDS)
    model = Model(shared_dir(spark, "lm"), shards)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Tally(model.word_shard)
        for batch in batches:
            for piece in slices(batch, 0):
                yield from counts.add(tokens(*utf8(piece.column(0)))[0])
        yield from counts.send()

    def merged_words(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = _joined(group)
        files = SharedFiles(model.folder)
        files.write(f"words-{key[0]}", hashes)
        files.write(f"count-{key[0]}", counts)
        # Of these are the words that are frequent in the whole corpus.
        top = np.flatnonzero(counts * HOT_SHARE >= counts.sum())
        return pd.DataFrame({"shard": [key[0]], "size": [len(hashes)], "total": [int(counts.sum())],
                             "top": [[{"at": int(i), "times": int(counts[i])} for i in top]]})

    merged = settled(texts.mapInArrow(words, PARTS).groupBy("shard").applyInPandas(
        merged_words, "shard int, size long, total long, top array<struct<at:long,times:long>>"), "words")
    by_shard = merged.select("shard", "size", "total").toPandas()
    total = int(by_shard["total"].sum())
    top = merged.select("shard", F.inline("top")).filter(F.col("times") * HOT_SHARE >= total).toPandas()
    sizes = np.zeros(shards, dtype=np.int64)
    sizes[by_shard["shard"]] = by_shard["size"]
    model.set_words(sizes, total, top)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, counts = Reader(model), _Tally(model.pair_shard)
        for batch in batches:
            for piece in slices(batch, 0):
                yield from counts.add(reader.pair_keys(*reader.token_ids(*utf8(piece.column(0)))))
        yield from counts.send()

    def merged_pairs(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        keys, counts = _joined(group)
        files = SharedFiles(model.folder)
        narrow = counts.astype(np.min_scalar_type(int(counts.max())))
        files.write(f"pairs-{shard}", keys)
        files.write(f"times-{shard}", narrow)
        context = keys >> np.uint64(32)
        heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        lines = np.stack([np.add.reduceat(x.astype(np.int64), heads) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)
        hot = np.isin(context[heads], model.hot)
        files.write(f"contexts-{shard}", context[heads][~hot])
        files.write(f"following-{shard}", lines[~hot])
        rows = [("shard", shard, np.array([narrow.itemsize, *[(counts == k).sum() for k in (1, 2, 3, 4)]], dtype=np.int64).tobytes(), b""),
                ("hot", shard, context[heads][hot].tobytes(), lines[hot].tobytes())]
        word, before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        for part in sharded(np.searchsorted(model.offsets, word.astype(np.int64), side="right") - 1, word, before):
            rows.append(("before", part.column(0)[0].as_py(), part.column(1)[0].as_py(), part.column(2)[0].as_py()))
        return pd.DataFrame(rows, columns=["kind", "shard", "keys", "counts"])

    found = settled(texts.mapInArrow(pairs, PARTS).groupBy("shard").applyInPandas(merged_pairs, f"kind string, {PARTS}"), "pairs")

    def merged_before(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        word, before = _joined(group)
        # Every word stands behind something, so the array runs along all words of the shard.
        SharedFiles(model.folder).write(f"before-{key[0]}", before)
        return pd.DataFrame({"pairs": [int(before.sum())], **{f"n{k}": [int((before == k).sum())] for k in (1, 2, 3, 4)}})

    before = (found.filter("kind = 'before'").select("shard", "keys", "counts").groupBy("shard")
              .applyInPandas(merged_before, "pairs long, n1 long, n2 long, n3 long, n4 long").toPandas().sum())
    stats = found.filter("kind = 'shard'").select("shard", "keys").toPandas()
    hot = found.filter("kind = 'hot'").select("keys", "counts").toPandas()
    model.set_pairs({s: np.frombuffer(k, np.int64) for s, k in zip(stats["shard"], stats["keys"])}, hot, before)
    return model


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns `carry` and n_tokens, n_known, train_tokens, base_score, score of every row.

    A text is its words and one end; null and empty texts are the end alone. score is the sum of the model's log10
    probabilities, base_score that of add-one unigrams with one further word for all unknown ones. Under a model of
    no texts, every token is unknown and both are 0. Repeated rows and ids are independent; other columns are not read.
    """
    schema = docs.select(*carry).schema.simpleString()[len("struct<"):-1]
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for piece in slices(batch, n):
                ids, counts = reader.token_ids(*utf8(piece.column(n)))
                heads = np.cumsum(counts) - counts
                known, base, full = log_probabilities(reader, ids, counts)
                sums = [np.add.reduceat(x, heads) for x in (known.astype(np.int64), base, full)]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n], pa.array(counts), pa.array(sums[0]), pa.array(np.full(len(counts), model.tokens)), *map(pa.array, sums[1:])],
                    names=[*carry, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(
        run, f"{schema}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def log_probabilities(reader: Reader, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, base log10 probability, model's log10 probability) of every token."""
    m = reader.model
    words, of_word = np.unique(ids, return_inverse=True)
    seen, before = reader.per_word("count", words), reader.per_word("before", words)
    base = np.log10((seen + 1) / (m.tokens + m.words + 1))
    low = np.maximum(before - m.d1[np.minimum(before, 3)], 0) / max(m.pairs, 1) + m.left1 / (m.words + 1)
    keys, of_key = np.unique(reader.pair_keys(ids, counts), return_inverse=True)
    context, of_context = np.unique(keys >> np.uint64(32), return_inverse=True)
    lines = reader.contexts(context)[of_context]
    times = reader.pairs(keys)
    low_of_key = low[np.searchsorted(words, keys & np.uint64(0xFFFFFFFF))]
    total = np.maximum(lines[:, 0], 1)
    # An unseen context leaves everything to the lower order.
    left = np.where(lines[:, 0] > 0, lines[:, 1:] @ m.d2[1:] / total, 1.0)
    full = np.maximum(times - m.d2[np.minimum(times, 3)], 0) / total + left * low_of_key
    return (seen > 0)[of_word], base[of_word], np.log10(full)[of_key]
