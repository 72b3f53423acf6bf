"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets.

A document has two collections of M short keys, each key the minima of ROWS hash functions. The key of
table (i, j) is the pair of the i-th key of the first and the j-th key of the second collection: M * M
tables from 2 * M keys, so about a square root of the minima that as many independent tables need. M follows from
the similarity sought: a pair at the threshold is missed with probability MISSED at most per collection.

Documents of one shingle set are one class, and only classes are compared. A class is a candidate only
where a key of each collection is shared, so most documents leave before a table is formed. Buckets never
give their pairs: families of near copies, which meet in very many buckets, are cut into blocks of bounded size, and
two blocks that meet in any bucket are confirmed together. One task holds two blocks, counts the
shingles that their sets share by matrix products, and gives out a spanning forest of the links, so a family of n
classes costs n rows of output and not its pairs. Links then become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import components, hash_words, meet, mix, slices, utf8
from emberlog.session import settled

#: Minima in a key, and the chance that a pair at the threshold shares no key of a collection.
ROWS, MISSED = 4, 1e-4
#: Shingles and classes of a block, about; columns of one matrix product, lines that are compared at once.
BLOCK_SHINGLES, BLOCK_CLASSES, COLUMNS, LINES = 1 << 17, 1 << 11, 2048, 256


def collections_for(similarity: float) -> int:
    """Keys per collection."""
    return math.ceil(math.log(MISSED) / math.log(1 - similarity ** ROWS))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in order, and the number of them per text.

    A text of fewer words is one shingle; a text without words has none.
    """
    words, counts = hash_words(data, offsets)
    ends = np.cumsum(counts)
    firsts = ends - counts
    total = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), total)
    at = np.repeat(firsts - (np.cumsum(total) - total), total) + np.arange(total.sum())
    length = np.minimum(counts, width)[row]
    hashes = mix(length.astype(np.uint64))
    for k in range(width):
        inside = k < length
        step = mix(hashes + words[np.minimum(at + k, max(len(words) - 1, 0))]) if len(words) else hashes
        hashes = np.where(inside, step, hashes)
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[new], np.bincount(row[new], minlength=len(counts))


def fingerprints(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which together with its size stand for the set."""
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(hashes):
        out[0, sizes > 0] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), heads)
        out[1, sizes > 0] = np.add.reduceat(mix(hashes ^ np.uint64(0x14057B7EF767814F)), heads)
    return out[0].view(np.int64), out[1].view(np.int64)


def keys(hashes: np.ndarray, sizes: np.ndarray, m: int) -> np.ndarray:
    """The 2 * m keys of each set as int64, zeros for an empty set."""
    rng = np.random.default_rng(7)
    spread = rng.integers(0, 1 << 63, (2 * m * ROWS, 2), dtype=np.uint64)
    heads = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.zeros((2 * m, len(sizes)), dtype=np.uint64)
    if len(hashes):
        for k in range(2 * m):
            key = np.full(len(heads), k, dtype=np.uint64)
            for f in range(k * ROWS, (k + 1) * ROWS):
                low = np.minimum.reduceat((hashes ^ spread[f, 0]) * (spread[f, 1] | np.uint64(1)), heads)
                key = mix(key * np.uint64(31) + low)
            out[k, sizes > 0] = key
    return out.view(np.int64)


def _signatures(docs: DataFrame, carry: list[str], width: int, m: int) -> DataFrame:
    names = [f"_k{i}" for i in range(2 * m)]
    kept = docs.select(*carry).schema.simpleString()[len("struct<"):-1]
    n = len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, n):
                hashes, sizes = shingle_sets(*utf8(piece.column(n)), width)
                one, two = fingerprints(hashes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:n], pa.array(sizes), pa.array(one), pa.array(two), *[pa.array(k) for k in keys(hashes, sizes, m)]],
                    names=[*carry, "_n", "_f1", "_f2", *names])

    schema = ", ".join([kept, "_n long, _f1 long, _f2 long", *[f"{k} long" for k in names]])
    return docs.select(*carry, "_text").mapInArrow(run, schema)


def _buckets(classes: DataFrame, m: int) -> DataFrame:
    """(_bucket, cid, _n): entries of table buckets with two classes at least; equal buckets stand once."""
    sides = [settled(
        classes.select("cid", F.posexplode(F.array(*[f"_k{i}" for i in range(s * m, (s + 1) * m)])).alias("_i", "_key")), "keys")
        for s in (0, 1)]
    shared = []
    for side, name in zip(sides, "xy"):
        twice = settled(side.groupBy("_i", "_key").agg(F.count("*").alias("_c")).filter("_c > 1").select("_i", "_key"), "shared")
        shared.append(side.join(twice, ["_i", "_key"]).select("cid", F.xxhash64("_i", "_key").alias(f"_{name}")))
    cells = settled(shared[0].join(shared[1], "cid").select(F.xxhash64("_x", "_y").alias("_bucket"), "cid"), "cells")
    # Two buckets of the same classes would give the same pairs.
    same = (cells.groupBy("_bucket").agg(F.count("*").alias("_c"), F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("_s"),
                                         F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("_b")).filter("_c > 1"))
    once = settled(same.groupBy("_c", "_s", "_b").agg(F.min("_bucket").alias("_bucket")).select("_bucket"), "once")
    return settled(cells.join(once, "_bucket").join(classes.select("cid", "_n"), "cid"), "buckets")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cid, _set) with the sorted hashes of each wanted class, from the text of the document that stands for it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 3):
                hashes, sizes = shingle_sets(*utf8(piece.column(3)), width)
                one, two = fingerprints(hashes, sizes)
                right = (one == piece.column(1).to_numpy()) & (two == piece.column(2).to_numpy())
                cuts = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.column(0).to_numpy()[right]),
                     pa.array([hashes[cuts[i] - sizes[i]:cuts[i]].tobytes() for i in np.flatnonzero(right)], pa.binary())], names=["cid", "_set"])

    texts = docs.select("doc_id", "_text").join(wanted, docs["doc_id"].eqNullSafe(wanted["_doc"]))
    # An id that repeats can bring a class twice.
    return (texts.select("cid", "_f1", "_f2", "_text").mapInArrow(run, "cid long, _set binary").dropDuplicates(["cid"]))


def _blocks(buckets: DataFrame) -> DataFrame:
    """(cid, block): classes that meet in buckets stand in the same blocks, as far as their size allows.

    The home of a class is the least hash around it after two steps over its buckets; a home is dealt out to as
    many blocks as its shingles or its classes fill, so that both a block's sets and its table of pairs are bounded.
    """
    home = buckets.select("cid", "_n").distinct().withColumn("home", F.xxhash64("cid"))
    for _ in range(2):
        least = buckets.join(home.select("cid", "home"), "cid").groupBy("_bucket").agg(F.min("home").alias("home"))
        home = settled(buckets.join(least, "_bucket").groupBy("cid", "_n").agg(F.min("home").alias("home")), "home")
    parts = F.greatest(F.ceil(F.sum("_n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES))
    sizes = settled(home.groupBy("home").agg(parts.alias("_parts"), F.count("*").alias("_size")), "sizes")
    part = F.pmod(F.xxhash64(F.lit("block"), "cid"), F.col("_parts"))
    return settled(meet(home, sizes, ["home"], "_size").select("cid", F.xxhash64("home", part).alias("block")), "blocks")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of x with all sets of y, by matrix products over bounded ranges of columns."""
    out = np.zeros((len(x), len(y)), dtype=np.int64)
    every = np.concatenate([*x, *y])
    if not len(every):
        return out
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    # A shingle of one set alone is in no intersection.
    shared = times > 1
    number = np.cumsum(shared) - 1
    kept = shared[column]
    column, row = number[column[kept]], row[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    width = int(shared.sum())
    for a in range(0, width, COLUMNS):
        cut = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        present = np.zeros((len(x) + len(y), min(COLUMNS, width - a)), dtype=np.float32)
        present[row[cut], column[cut] - a] = 1
        out += (present[:len(x)] @ present[len(x):].T).astype(np.int64)
    return out


def linked(x: list[np.ndarray], y: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which sets of x and y have a similarity of num / den or more."""
    both = overlaps(x, y)
    of_x, of_y = (np.array([len(s) for s in side], dtype=np.int64) for side in (x, y))
    out = np.zeros(both.shape, dtype=bool)
    for a in range(0, len(x), LINES):
        part = both[a:a + LINES]
        out[a:a + LINES] = den * part >= num * (of_x[a:a + LINES, None] + of_y[None, :] - part)
    return out


def forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links (line of x, line of y) that connect whatever the matrix of links connects; `same`: x and y are one list."""
    lines, columns = linked.shape
    free = [np.ones(lines, bool), np.ones(columns, bool)]
    if same:
        free[1] = free[0]
    views, out = (linked, linked.T), []
    for start in range(lines):
        if not free[0][start]:
            continue
        free[0][start] = False
        todo = [(0, start)]
        while todo:
            side, at = todo.pop()
            other = side if same else 1 - side
            found = np.flatnonzero(views[side][at] & free[other])
            free[other][found] = False
            out += [(at, f) if side == 0 else (f, at) for f in found.tolist()]
            todo += [(other, f) for f in found.tolist()]
    return out


def _links(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect all classes of similarity num / den or more within two blocks that share a bucket."""
    blocks = _blocks(buckets)
    held = settled(buckets.select("_bucket", "cid").join(blocks, "cid").select("_bucket", "block").distinct(), "held")
    several = held.groupBy("_bucket").agg(F.count("*").alias("_c")).filter("_c > 1").select("_bucket")
    across = held.join(several, "_bucket")
    tiles = settled(
        across.select("_bucket", F.col("block").alias("x")).join(across.select("_bucket", F.col("block").alias("y")), "_bucket")
        .filter("x < y").select("x", "y").distinct()
        .unionByName(held.select(F.col("block").alias("x")).distinct().withColumn("y", F.col("x"))), "tiles")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cid")
        return pd.DataFrame({"block": group["block"].iloc[:1], "cids": [group["cid"].to_numpy(np.int64).tobytes()],
                             "lengths": [group["_set"].map(len).to_numpy(np.int64).tobytes()], "sets": [b"".join(group["_set"])]})

    packs = settled(sets.join(blocks, "cid").select("block", "cid", "_set").groupBy("block")
                    .applyInPandas(packed, "block long, cids binary, lengths binary, sets binary"), "packs")

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part = [batch.column(c)[row].as_buffer() for c in range(6)]
                (x_ids, x), (y_ids, y) = _unpacked(*part[:3]), _unpacked(*part[3:])
                links = np.array(forest(linked(x, y, num, den), batch.column(0)[row] == batch.column(3)[row]), dtype=np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x_ids[links[:, 0]]), pa.array(y_ids[links[:, 1]])], names=["a", "b"])

    of_x, of_y = (packs.select(F.col("block").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("cids", "lengths", "sets")]) for n in "xy")
    return (tiles.join(of_x, "x").join(of_y, "y").select(*[f"{n}_{c}" for n in "xy" for c in ("cids", "lengths", "sets")])
            .mapInArrow(confirmed, "a long, b long"))


def _unpacked(cids: pa.Buffer, lengths: pa.Buffer, sets: pa.Buffer) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.cumsum(np.frombuffer(lengths, np.int64) // 8)
    return np.frombuffer(cids, np.int64), np.split(np.frombuffer(sets, np.uint64), cuts[:-1])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80,
               den: int = 100, carry: list[str] | None = None, group: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, and the columns `carry`.

    Documents are linked when den * intersection >= num * union of their sets of distinct `width`-word shingles
    (A-Z lower-cased; fewer words are one shingle). component_id is the smallest doc_id reachable over links, kept tells
    whether that is the row's own. A text that is null, empty or without words is linked with nothing and kept. Rows
    that repeat an id are compared as rows of their own and carry the result of their own text; a null
    id counts only where all of a component are null. An empty table gives an empty result.

    As ids can repeat or be null, component_id does not tell components apart. The column named by `group` does: a
    number per component, null for a text without words.
    """
    m = collections_for(num / den)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *(carry or []))
    given = ["doc_id", *(carry or [])]
    signed = settled(_signatures(rows, given, width, m), "signatures")
    names = [f"_k{i}" for i in range(2 * m)]
    one_set = ["_f1", "_f2", "_n"]
    classes = settled(
        signed.filter("_n > 0").groupBy(*one_set).agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_size"), *[F.min(k).alias(k) for k in names])
        .withColumn("cid", F.monotonically_increasing_id()), "classes")
    # Two different sets are at most as similar as a set of n and one more: below that size a class has no other to be linked with.
    buckets = _buckets(classes.filter(F.col("_n") * den >= (F.col("_n") + 1) * num), m)
    wanted = classes.select("cid", "_doc", "_f1", "_f2").join(buckets.select("cid").distinct(), "cid")
    sets = settled(_sets(rows, wanted, width), "sets")
    labels = settled(components(buckets.select(F.col("cid").alias("node")).distinct(), _links(buckets, sets, num, den)), "labels")
    smallest = classes.select("cid", "_doc").join(labels.toDF("cid", "label"), "cid")
    least = smallest.groupBy("label").agg(F.min("_doc").alias("_least"))
    of_class = smallest.join(least, "label").select("cid", "_least", "label")
    # Labels are numbers of classes; a class without links is a component of its own.
    numbered = [F.coalesce("label", "cid").alias(group)] if group else []
    result = settled(classes.select("cid", *one_set, "_size", "_doc").join(of_class, "cid", "left")
                     .select(*one_set, "_size", F.coalesce("_least", "_doc").alias("component_id"), *numbered), "result")
    texts = meet(signed.filter("_n > 0").select(*given, *one_set), result, one_set, "_size")
    bare = signed.filter("_n = 0").withColumn("component_id", F.col("doc_id"))
    out = [F.col("_n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    if group:
        bare = bare.withColumn(group, F.lit(None).cast("long"))
        out.append(group)
    return (texts.select("doc_id", *out, *(carry or [])).unionByName(bare.select("doc_id", *out, *(carry or []))))
