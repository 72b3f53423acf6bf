"""Helpers that the operators share: byte-level words in numpy, deterministic splits, reading tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step handles.
WINDOW = 1 << 20
#: A key is hot from this many rows on, and from one row in HOT_SHARE on, so that at most HOT_SHARE keys are hot.
HOT_ROWS, HOT_SHARE = 500, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- words of UTF-8 bytes -------------------------------------------------------------------------

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A"):ord("Z") + 1] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BYTE_VALUE = np.random.default_rng(20240310).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """Powers of the base of the polynomial hash, modulo 2**64."""
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the bytes at white space or row ends, about WINDOW long (longer only for one huge word)."""
    at, end = 0, len(data)
    while at < end:
        cut = min(at + WINDOW, end)
        while cut < end:
            row_end = offsets[np.searchsorted(offsets, cut)]
            gaps = np.flatnonzero(~_IS_WORD[data[cut:cut + 4096]])
            if len(gaps) and cut + gaps[0] <= row_end:
                cut += int(gaps[0])
                break
            if row_end <= cut + 4096:
                cut = int(row_end)
                break
            cut = min(cut + 4096, end)
        yield at, cut
        at = cut


def hash_words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all rows in order, and the number of words per row.

    A word is a run of bytes other than 9 to 13 and 32, which no multi-byte character contains. With `prefixes`,
    one line of hashes for the words and one for their first n bytes, for each n given.
    """
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(offsets) - 1, dtype=np.int64)
    power = powers(64)
    for a, b in windows(data, offsets):
        part = data[a:b]
        word = _IS_WORD[part]
        edge = np.zeros(b - a + 1, dtype=bool)
        first, last = np.searchsorted(offsets, [a, b])
        edge[offsets[first:last] - a] = True
        edge[0] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
        if not len(starts):
            continue
        kept = part[word]
        # Positions of the starts among the kept bytes.
        heads = (np.cumsum(word) - 1)[starts]
        lengths = np.diff(np.append(heads, len(kept)))
        longest = int(lengths.max())
        if longest > len(power):
            power = powers(longest)
        place = np.arange(len(kept)) - np.repeat(heads, lengths)
        value = _BYTE_VALUE[_LOWERED[kept]] * power[place]
        lines = [np.add.reduceat(value, heads), *[np.add.reduceat(np.where(place < n, value, np.uint64(0)), heads) for n in prefixes]]
        hashes.append(mix(np.stack(lines) if prefixes else lines[0]))
        counts += np.bincount(np.searchsorted(offsets, starts + a, side="right") - 1, minlength=len(counts))
    none = np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    return np.concatenate([*hashes, none], axis=-1), counts


def hash_word(word: str) -> int:
    """The hash of one word, as `hash_words` gives it."""
    raw = word.encode()
    return int(hash_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0][0])


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 * WINDOW) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with at most `limit` bytes of text each (one row may be longer)."""
    _, offsets = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


# --- graphs and groups in DataFrames --------------------------------------------------------------

def meet(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of rows with their groups (one row per key, `size` rows each) without a hot key in the shuffle.

    At most HOT_SHARE groups are so large that each holds one row in HOT_SHARE; those meet their rows by
    broadcast, which that number bounds. `groups` should be a written table, it is read a few times.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // HOT_SHARE))
    large, small = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    return (rows.join(F.broadcast(large), key)
            .unionByName(rows.join(F.broadcast(large.select(*key)), key, "left_anti").join(small, key)))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with one label per connected component, from (node) and undirected links (a, b) among them.

    Each round maps every linked node to the least node around it and contracts the links, until none is left;
    stars go in one or two rounds, chains shrink by half or more. Every round is a written table.
    """
    labels = nodes.select("node", F.col("node").alias("label"))
    edges = settled(links.select("a", "b").filter("a != b").distinct(), "links")
    while not edges.isEmpty():
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(around.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).filter("to != a"), "least")
        of_a = least.select("a", F.col("to").alias("to_a"))
        of_b = least.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = (edges.join(of_a, "a", "left").join(of_b, "b", "left")
                 .select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")))
        edges = settled(moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        step = least.select(F.col("a").alias("label"), "to")
        labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return labels


def spare(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
