"""Nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised by its own centroids; a pair of centroids is a cell. A query ranks the
centroids of either half by their inner product with its own half and walks the pairs in descending order of the
sum with a heap, until the cells it met hold a share of all vectors, the coverage. The vectors of those
cells, and no others, are then scored exactly.

The coverage is measured: for a bounded sample of queries the true neighbours among all vectors are found, and it is set so
that the walk meets the share RECALL of them. Vectors without structure need a large one, clustered ones a small one.

The centroids are fitted on a bounded sample; every vector is indexed. Cells grow with the table up to MOST * MOST. The cells of one
first centroid are cut into blocks of bounded size, a large cell into several; a query travels to the blocks
that hold a cell it met, in packs of bounded size. Nothing is gathered whole.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import settled

#: Bound of the sample that the centroids are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 16_384, 12
#: Centroids per half: the square root of vectors / PER_CELL, between these bounds.
PER_CELL, FEWEST, MOST = 50, 8, 1024
#: Share of the true neighbours that the walk has to meet, and the queries that it is measured on.
RECALL, MEASURED = 0.94, 256
#: Vectors of a block and queries of a pack, about.
BLOCK, PACK = 4096, 1024


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantise(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of the lines of x by k-means from seeded distinct lines."""
    lines = np.unique(x, axis=0)
    rng = np.random.default_rng(5)
    centres = lines[rng.choice(len(lines), min(k, len(lines)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


class MultiIndex:
    """Centroids of both halves; a vector of one component has an empty second half and one cell there."""

    def __init__(self, first: np.ndarray, second: np.ndarray) -> None:
        self.first, self.second = first, second

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        near = [((c ** 2).sum(axis=1) - 2 * half @ c.T).argmin(axis=1) for half, c in ((x[:, :h], self.first), (x[:, h:], self.second))]
        return near[0], near[1]

    def halves(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inner products of the query's halves with the centroids."""
        h = self.first.shape[1]
        return self.first @ query[:h], self.second @ query[h:]

    def visit(self, query: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """The cells met, as first and second centroids, in descending order of the summed inner products, until they hold
        `wanted` vectors. Empty cells are passed over."""
        one, two = self.halves(query)
        by_one, by_two = np.argsort(-one, kind="stable").tolist(), np.argsort(-two, kind="stable").tolist()
        one, two = -np.sort(-one), -np.sort(-two)
        one, two = one.tolist(), two.tolist()
        heap, found = [(-(one[0] + two[0]), 0, 0)], 0
        met: list[tuple[int, int]] = []
        while heap and found < wanted:
            _, i, j = heapq.heappop(heap)
            a, b = by_one[i], by_two[j]
            if counts[a, b]:
                met.append((a, b))
                found += int(counts[a, b])
            # Every pair is pushed once: along a line, and to the next line from its first pair.
            if j + 1 < len(two):
                heapq.heappush(heap, (-(one[i] + two[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (-(one[i + 1] + two[0]), i + 1, 0))
        cells = np.array(met, dtype=np.int64).reshape(-1, 2)
        return cells[:, 0], cells[:, 1]

    def needed(self, query: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each cell the number of vectors in cells that the walk meets up to it (with those of equal sums)."""
        one, two = self.halves(query)
        sums = one[:, None] + two[None, :]
        return np.array([counts[sums >= sums[i, j]].sum() for i, j in zip(a, b)], dtype=np.int64)


class Blocks:
    """Cuts the cells of each first centroid, in the order of the second one, into blocks of about BLOCK vectors."""

    def __init__(self, counts: np.ndarray) -> None:
        upto = counts.cumsum(axis=1)
        per_line = np.maximum(-(-upto[:, -1] // BLOCK), 1)
        base = (per_line.cumsum() - per_line)[:, None]
        self.count = int(per_line.sum())
        #: First block and number of blocks by cell; a cell's vectors are dealt out among its blocks.
        self.first = (base + (upto - counts) // BLOCK).astype(np.int32)
        self.wide = np.where(counts > 0, base + (upto - 1) // BLOCK - self.first + 1, 0).astype(np.int32)
        #: Least second centroid of a block, and the greatest number of them in one.
        self.low = np.full(self.count, counts.shape[1])
        high = np.zeros(self.count, dtype=np.int64)
        a, b = np.nonzero(counts)
        cell, block = self.spread(a, b)
        np.minimum.at(self.low, block, b[cell])
        np.maximum.at(high, block, b[cell])
        self.span = max(int((high - self.low).max()) + 1, 1)

    def spread(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the given cells, block) for every block of every cell."""
        wide = self.wide[a, b]
        cell = np.repeat(np.arange(len(a)), wide)
        within = np.arange(len(cell)) - np.repeat(wide.cumsum() - wide, wide)
        return cell, self.first[a, b][cell] + within

    def routes(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks that hold some of the given cells, and for each a line of bits that tells which second centroids."""
        cell, block = self.spread(a, b)
        blocks, line = np.unique(block, return_inverse=True)
        bits = np.zeros((len(blocks), self.span), dtype=bool)
        bits[line, b[cell] - self.low[block]] = True
        return blocks, np.packbits(bits, axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


def fit(vectors: DataFrame, n: int, sample: int = SAMPLE) -> MultiIndex:
    """From rows (vec_id, v): the `sample` rows of smallest seeded hash of the id."""
    k = int(min(max(round((n / PER_CELL) ** 0.5), FEWEST), MOST))
    chosen = vectors.withColumn("_order", F.xxhash64(F.lit("ann"), "vec_id")).orderBy("_order", "vec_id").limit(sample)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values(["_order", "vec_id"])["v"].to_numpy()).astype(np.float64)
        h = (x.shape[1] + 1) // 2
        halves = [quantise(x[:, :h], k), quantise(x[:, h:], k)]
        return pd.DataFrame({"half": [0, 1], "lines": [len(c) for c in halves], "c": [c.tobytes() for c in halves]})

    fitted = chosen.groupBy(F.lit(0).alias("one")).applyInPandas(learn, "half int, lines int, c binary").toPandas().sort_values("half")
    first, second = (np.frombuffer(c, np.float64).reshape(lines, -1) for lines, c in zip(fitted["lines"], fitted["c"]))
    return MultiIndex(first, second)


def _best(fast: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query line, vector line, score) of the k best of each line of inner products, without those of minus infinity."""
    least = np.partition(fast, -k, axis=1)[:, -k] if fast.shape[1] > k else np.full(len(fast), -np.inf)
    # Matrix products may round differently from place to place, so all that is within rounding is scored anew.
    slack = 1e-9 * (np.linalg.norm(q, axis=1) * max(1e-300, float(np.linalg.norm(x, axis=1).max())))
    line, vector = np.nonzero((fast >= (least - slack)[:, None]) & (fast > -np.inf))
    score = np.zeros(len(line))
    for c in range(q.shape[1]):
        score += q[line, c] * x[vector, c]
    order = np.lexsort((ids[vector], -score, line))
    line, vector, score = line[order], vector[order], score[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < k], vector[place < k], score[place < k]


def _scores(rids: np.ndarray, second: np.ndarray, x: np.ndarray, qrids: np.ndarray, wants: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of a pack with a block, minus infinity where a query did not meet the vector's cell. `second` ascends
    and counts from the block's least second centroid; `wants` has a line of these per query."""
    fast = np.full((len(q), len(x)), -np.inf)
    edges = np.flatnonzero(np.diff(second, prepend=-1, append=-1))
    for low, high in zip(edges[:-1], edges[1:]):
        asks = np.flatnonzero(wants[:, second[low]])
        if len(asks):
            fast[asks, low:high] = q[asks] @ x[low:high].T
    _, mine, own = np.intersect1d(qrids, rids, assume_unique=True, return_indices=True)
    fast[mine, own] = -np.inf
    return fast


def measured_coverage(table: DataFrame, asked: DataFrame, index: MultiIndex, counts: np.ndarray, k: int) -> float:
    """The coverage at which the walk meets the share RECALL of the true neighbours of MEASURED queries (of smallest seeded
    hash). One pass over the vectors; a task keeps k of them per query."""
    some = (asked.select("vec_id", "rid", "v").orderBy(F.xxhash64(F.lit("measure"), "rid"), "rid").limit(MEASURED).toPandas())
    if some.empty:
        return 1.0
    q, qrids = np.stack(some["v"].to_numpy()).astype(np.float64), some["rid"].to_numpy(np.int64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, rids, ids = _matrix(batch.column(2)), batch.column(1).to_numpy(), batch.column(0).to_numpy()
            fast = q @ x.T
            _, mine, own = np.intersect1d(qrids, rids, return_indices=True)
            fast[mine, own] = -np.inf
            line, vector, score = _best(fast, q, x, ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(ids[vector]), pa.array(score), batch.column(3).take(pa.array(vector)),
                                              batch.column(4).take(pa.array(vector))], names=["line", "vec_id", "score", "a", "b"])

    def needs(group: pd.DataFrame) -> pd.DataFrame:
        query = q[int(group["line"].iloc[0])]
        return pd.DataFrame({"need": index.needed(query, counts, group["a"].to_numpy(), group["b"].to_numpy())})

    best = Window.partitionBy("line").orderBy(F.desc("score"), "vec_id")
    true = (table.select("vec_id", "rid", "v", "a", "b").mapInArrow(nearest, "line long, vec_id long, score double, a int, b int")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))
    found = true.groupBy("line").applyInPandas(needs, "need long").toPandas()["need"].to_numpy()
    if not len(found):
        return 1.0
    return float(np.quantile(found, RECALL, method="higher")) / float(counts.sum())


def search(vectors: DataFrame, queries: Column, k: int = 20, coverage: float | None = None, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies `queries`, its k nearest found, nearest first.

    `queries` is a condition on the column vec_id. All rows but the query's own are candidates; ties go to the
    smaller vec_id. Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do those
    whose length is not the most frequent one. Rows that repeat an id are rows of their own. With fewer candidates
    than k all that the visited cells hold are returned, which then are all cells. An empty table gives an empty result.
    `coverage` is the share of all vectors whose cells a query visits; it is measured if not given.
    """
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    lengths = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    if lengths is None:
        return spark.createDataFrame([], result)
    length, n = int(lengths["length"]), int(lengths["n"])
    rows = rows.filter(F.size("v") == length)
    index = fit(rows, n)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = index.cells(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))],
                                             names=["vec_id", "v", "a", "b"])

    table = settled(rows.mapInArrow(placed, "vec_id long, v array<double>, a int, b int")
                    .withColumn("rid", F.monotonically_increasing_id()), "index")
    found = table.groupBy("a", "b").agg(F.count("*").alias("n")).toPandas()
    counts = np.zeros((len(index.first), len(index.second)), dtype=np.int64)
    counts[found["a"], found["b"]] = found["n"]
    layout = Blocks(counts)
    asked = table.filter(queries)
    if n <= k + 1:
        wanted = n
    else:
        share = measured_coverage(table, asked, index, counts, k) if coverage is None else coverage
        wanted = max(int(np.ceil(share * n)), k + 1)
    packs = max(1, -(-asked.count() // PACK))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, turn = (batch.column(c).to_numpy() for c in (3, 4, 5))
            block = layout.first[a, b] + turn % layout.wide[a, b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(block.astype(np.int64)), pa.array((b - layout.low[block]).astype(np.int64))],
                names=["vec_id", "rid", "v", "block", "code"])

    def routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, query in enumerate(_matrix(batch.column(2))):
                blocks, bits = layout.routes(*index.visit(query, counts, wanted))
                at = pa.array(np.full(len(blocks), line))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(blocks.astype(np.int64)),
                     pa.array([b.tobytes() for b in bits], pa.binary())], names=["vec_id", "rid", "v", "block", "bits"])

    def packed(group: pd.DataFrame) -> dict[str, list]:
        return {"block": [int(group["block"].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()],
                "rids": [group["rid"].to_numpy(np.int64).tobytes()], "x": [np.stack(group["v"].to_numpy()).astype(np.float64).tobytes()]}

    def one_block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["code", "rid"])
        return pd.DataFrame({**packed(group), "codes": [group["code"].to_numpy(np.int64).tobytes()]})

    def one_pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid")
        return pd.DataFrame({**packed(group), "bits": [b"".join(group["bits"])]})

    turn = F.pmod(F.xxhash64("rid"), F.lit(1 << 40)).alias("turn")
    blocks = (table.select("vec_id", "rid", "v", "a", "b", turn).mapInArrow(dealt, "vec_id long, rid long, v array<double>, block long, code long")
              .groupBy("block").applyInPandas(one_block, "block long, ids binary, rids binary, x binary, codes binary"))
    sent = (asked.select("vec_id", "rid", "v").mapInArrow(routes, "vec_id long, rid long, v array<double>, block long, bits binary")
            .groupBy("block", F.pmod(F.xxhash64("rid"), F.lit(packs)).alias("pack"))
            .applyInPandas(one_pack, "block long, ids binary, rids binary, x binary, bits binary")
            .select("block", F.col("ids").alias("qids"), F.col("rids").alias("qrids"), F.col("x").alias("q"), "bits"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, rids, codes, qids, qrids = (np.frombuffer(batch.column(c)[row].as_buffer(), np.int64) for c in range(5))
                x, q = (np.frombuffer(batch.column(c)[row].as_buffer(), np.float64).reshape(-1, length) for c in (5, 6))
                bits = np.frombuffer(batch.column(7)[row].as_buffer(), np.uint8).reshape(len(q), -1)
                fast = _scores(rids, codes, x, qrids, np.unpackbits(bits, axis=1).view(bool), q)
                line, vector, score = _best(fast, q, x, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[line]), pa.array(qrids[line]), pa.array(ids[vector]), pa.array(score)],
                                                 names=["query_id", "qrid", "vec_id", "score"])

    near = (sent.join(blocks, "block").select("ids", "rids", "codes", "qids", "qrids", "x", "q", "bits")
            .mapInArrow(scored, "query_id long, qrid long, vec_id long, score double"))
    best = Window.partitionBy("query_id", "qrid").orderBy(F.desc("score"), "vec_id")
    return (near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
