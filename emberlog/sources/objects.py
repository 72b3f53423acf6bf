"""An index of a table's data files: what a search must know of a file to leave it unread.

One line per file (or part of a file that one task read): rows, bytes, time span, its sources and levels if they are few,
and a Bloom filter of the byte trigrams of its messages. A message that contains a text contains all trigrams of the text, so
a part that lacks one of them has no match; a filter never denies a trigram that is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.timefmt import micros, utc
from emberlog.plans.query import LogQuery

#: A file with more different values than this has none listed and is always read.
LISTED_VALUES = 256
#: Bits of a filter per different trigram, and positions that a trigram sets. About one trigram in 50 is wrongly
#: affirmed, and a text has to be wrongly affirmed in all its trigrams.
BITS_PER_TRIGRAM, POSITIONS = 8, 4
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 26
#: Bytes of messages that one vectorised step handles.
STEP = 1 << 22
#: Files whose summaries a task holds before it gives them out.
HELD_FILES = 1_000

INDEX_SCHEMA = T.StructType([
    T.StructField("object", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("min_us", T.LongType()),
    T.StructField("max_us", T.LongType()),
    T.StructField("sources", T.ArrayType(T.StringType())),
    T.StructField("levels", T.ArrayType(T.StringType())),
    T.StructField("trigrams", T.ArrayType(T.LongType())),
])


@dataclass(frozen=True)
class DataObject:
    """A data file that a search may have to read."""

    path: str
    bytes: int
    rows: int
    min_us: int
    max_us: int


def _hashes(trigrams: np.ndarray) -> np.ndarray:
    """POSITIONS hashes of each trigram (three bytes as one integer), as one line each."""
    x = trigrams.astype(np.uint64) + np.uint64(1)
    lines = []
    for i in range(POSITIONS):
        y = (x + np.uint64(i << 32)) * np.uint64(0x9E3779B97F4A7C15)
        y = (y ^ (y >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        lines.append((y ^ (y >> np.uint64(32))) >> np.uint64(16))
    return np.stack(lines).astype(np.int64)


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The different byte trigrams inside the texts between the offsets, ascending."""
    found = [np.zeros(0, np.int32)]
    for at in range(0, len(data), STEP):
        part = data[at:at + STEP + 2].astype(np.int32)
        if len(part) < 3:
            break
        codes = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        inside = np.ones(len(codes), dtype=bool)
        # The last two bytes before an offset begin no trigram of that text.
        for back in (1, 2):
            ends = offsets - back - at
            inside[ends[(ends >= 0) & (ends < len(codes))]] = False
        found.append(np.unique(codes[inside]))
    return np.unique(np.concatenate(found))


def trigrams_of(text: str) -> np.ndarray:
    """The different byte trigrams of one text; none if it is shorter than three bytes."""
    raw = text.encode()
    return _trigrams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


def bloom_words(trigrams: np.ndarray) -> np.ndarray:
    """A filter as 64-bit words; their number, a power of two, follows the number of trigrams."""
    bits = LEAST_BITS
    while bits < BITS_PER_TRIGRAM * len(trigrams) and bits < MOST_BITS:
        bits *= 2
    places = _hashes(trigrams).ravel() & (bits - 1)
    flags = np.zeros(bits, dtype=np.uint8)
    flags[places] = 1
    return np.packbits(flags, bitorder="little").view("<i8")


def may_contain(words: Column, text: str) -> Column:
    """Does a filter affirm all trigrams of a text? Null filters and short texts always do."""
    hashes = np.unique(_hashes(trigrams_of(text)))
    if not len(hashes):
        return F.lit(True)
    bits = F.size(words).cast("long") * 64

    def is_set(h: Column) -> Column:
        place = h.bitwiseAND(bits - 1)
        word = F.get(words, F.shiftright(place, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return words.isNull() | F.forall(F.array(*[F.lit(int(h)) for h in hashes]), is_set)


class _Summary:
    """What one task has seen of one file."""

    def __init__(self, size: int) -> None:
        self.size, self.rows = size, 0
        self.low: int | None = None
        self.high: int | None = None
        self.values: dict[str, set | None] = {"source": set(), "level": set()}
        self.trigrams = np.zeros(0, np.int32)

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        span = pc.min_max(batch.column("us"))
        if (low := span["min"].as_py()) is not None:
            self.low = low if self.low is None else min(self.low, low)
            self.high = span["max"].as_py() if self.high is None else max(self.high, span["max"].as_py())
        for name, known in self.values.items():
            if known is not None:
                known |= set(pc.unique(batch.column(name)).to_pylist()) - {None}
                if len(known) > LISTED_VALUES:
                    self.values[name] = None
        texts = batch.column("message").cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
        self.trigrams = np.union1d(self.trigrams, _trigrams(data, offsets - offsets[0]))


def summarise(table: DataFrame) -> DataFrame:
    """Index lines (INDEX_SCHEMA) of the files of a log table. Null messages contain nothing, null times lie in no range."""
    read = table.select(
        F.col("_metadata.file_path").alias("object"), F.col("_metadata.file_size").alias("bytes"),
        F.unix_micros("timestamp").alias("us"), "source", "level", "message")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Summary] = {}
        for batch in batches:
            # The rows of a file follow each other.
            for first, last in _runs(batch.column("object")):
                part = batch.slice(first, last - first)
                path = part.column("object")[0].as_py()
                if path not in known:
                    if len(known) == HELD_FILES:
                        yield _lines(known)
                        known = {}
                    known[path] = _Summary(part.column("bytes")[0].as_py())
                known[path].add(part)
        if known:
            yield _lines(known)

    return read.mapInArrow(run, INDEX_SCHEMA)


def _lines(known: dict[str, _Summary]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([
        {"object": path, "bytes": s.size, "rows": s.rows, "min_us": s.low, "max_us": s.high,
         **{f"{name}s": None if values is None else sorted(values) for name, values in s.values.items()},
         "trigrams": bloom_words(s.trigrams).tolist()} for path, s in known.items()], schema=_ARROW)


def _runs(paths: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row behind the last) of the runs of equal values."""
    ends = pc.run_end_encode(paths).run_ends.to_pylist()
    yield from zip([0, *ends], ends)


_ARROW = pa.schema([
    ("object", pa.string()), ("bytes", pa.int64()), ("rows", pa.int64()), ("min_us", pa.int64()), ("max_us", pa.int64()),
    ("sources", pa.list_(pa.string())), ("levels", pa.list_(pa.string())), ("trigrams", pa.list_(pa.int64()))])


def candidates(index: DataFrame, query: LogQuery, start: datetime | str | None, end: datetime | str | None) -> list[DataObject]:
    """The files that may hold a match, in order of their first time: one line per file comes to the driver, as in any
    listing, and none for files that the index rules out."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (F.col("max_us") >= micros(utc(start)))
    if end is not None:
        keep = keep & (F.col("min_us") <= micros(utc(end)))
    for name, value in (("sources", query.source), ("levels", query.level)):
        if value:
            keep = keep & F.coalesce(F.array_contains(name, value), F.lit(True))
    if query.text:
        keep = keep & may_contain(F.col("trigrams"), query.text)
    # Parts of one file stand alone: a match lies in one of them.
    found = index.filter(keep).groupBy("object").agg(
        F.max("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("min_us").alias("min_us"), F.max("max_us").alias("max_us"))
    return sorted((DataObject(*row) for row in found.collect()), key=lambda o: (o.min_us, o.path))
