"""Target-distribution importance resampling over hashed features, with a CRC-32 computed over whole arrays.

CRC-32 is affine: the checksum of a span of n bytes is a constant of n, XOR what each byte contributes by its distance
from the end. Contributions lie in a table (byte by distance), so one gather and one `bitwise_xor.reduceat` give the
checksums of all words of a block of text. Words longer than the table are cut into its length from the end; each part is
moved over the bytes behind it by squared shift operators and the parts are folded, and a word that crosses blocks is
folded from its parts the same way, so memory is bounded by a block whatever the length of a word. Runs of
several words fold the checksums of their words.

A feature's bucket is its checksum modulo the number of buckets. Buckets are counted over the raw and the target texts, a
bucket's gain is its log ratio, a document's weight is the mean gain of its features, and documents are drawn without
replacement by the highest weight plus Gumbel noise of a hash of the id. Texts are read twice and never shuffled; what
is shuffled are a task's bucket counts and one line of numbers per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import slices, spare, utf8
from emberlog.session import settled

POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table of contributions holds.
REACH = 64
#: Bytes of text that one vectorised step handles.
BLOCK = 1 << 20
BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Gains and noise are in thousandths.
SCALE = 1000

# --- CRC-32 of many spans -------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """The register after one byte, from the low byte of the register before it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


def _past_zero(register: np.ndarray, table: np.ndarray) -> np.ndarray:
    return register >> np.uint32(8) ^ table[register & np.uint32(255)]


class Crc:
    """Checksums of spans; a span's part without its length's constant is called its sum here."""

    def __init__(self) -> None:
        one = _byte_table()
        lines = [one]
        constants = [np.uint32(0xFFFFFFFF)]
        for _ in range(REACH):
            lines.append(_past_zero(lines[-1], one))
            constants.append(_past_zero(constants[-1], one))
        #: contributions[distance << 8 | byte]
        self.contributions = np.concatenate(lines[:REACH])
        #: The register after n zero bytes from its initial value.
        self.constants = np.array(constants, dtype=np.uint32)
        # Operators that move a register over 2**k zero bytes, as four tables of 256 registers each.
        basis = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
        self.operators = [_past_zero(basis, one)]
        while len(self.operators) < 40:
            self.operators.append(self._move(self.operators[-1], self.operators[-1]))

    @staticmethod
    def _move(registers: np.ndarray, operator: np.ndarray) -> np.ndarray:
        out = operator[0][registers & np.uint32(255)]
        for k in range(1, 4):
            out = out ^ operator[k][registers >> np.uint32(8 * k) & np.uint32(255)]
        return out

    def moved(self, registers: np.ndarray, zeros: np.ndarray) -> np.ndarray:
        """Registers after so many zero bytes each."""
        registers, left = registers.copy(), zeros.astype(np.int64)
        for operator in self.operators:
            if not left.any():
                break
            odd = np.flatnonzero(left & 1)
            registers[odd] = self._move(registers[odd], operator)
            left = left >> 1
        return registers

    def sums(self, data: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of spans that follow each other without gaps in `data`; none is empty."""
        distance = np.repeat((heads + lengths).astype(np.int32), lengths) - np.arange(1, len(data) + 1, dtype=np.int32)
        if lengths.max(initial=0) <= REACH:
            return np.bitwise_xor.reduceat(self.contributions[distance << 8 | data], heads) if len(heads) else np.zeros(0, np.uint32)
        part, within = distance // REACH, distance % REACH
        cut = within == REACH - 1
        cut[heads] = True
        cuts = np.flatnonzero(cut)
        sums = np.bitwise_xor.reduceat(self.contributions[within << 8 | data], cuts)
        return np.bitwise_xor.reduceat(self.moved(sums, part[cuts] * REACH), np.searchsorted(cuts, heads))

    def checksums(self, sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of spans from their sums and lengths."""
        constants = self.constants[lengths % REACH]
        long = np.flatnonzero(lengths >= REACH)
        constants[long] = self.moved(constants[long], lengths[long] // REACH * REACH)
        return sums ^ constants ^ np.uint32(0xFFFFFFFF)

    def joined(self, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sums of left + " " + right, for right parts of the given lengths."""
        spaced = _past_zero(left, self.contributions[:256]) ^ self.contributions[ord(" ")]
        return self.moved(spaced, lengths) ^ right


_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A"):ord("Z") + 1] += 32
# Words are runs of 0-9, a-z and bytes of characters beyond ASCII.
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[ord("0"):ord("9") + 1] = _IS_WORD[ord("a"):ord("z") + 1] = _IS_WORD[128:] = True


def word_sums(crc: Crc, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, lengths, rows) of the words of all rows in order, A-Z lower-cased."""
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # What the last block left open: sum and length of a word that may go on.
    open_sum, open_length, open_row = np.uint32(0), 0, 0

    def close() -> None:
        nonlocal open_length
        if open_length:
            found.append((np.array([open_sum], np.uint32), np.array([open_length]), np.array([open_row])))
            open_length = 0

    for at in range(0, len(data), BLOCK):
        part = _LOWERED[data[at:at + BLOCK]]
        word = _IS_WORD[part]
        if open_length and (edge[at] or not word[0]):
            close()
        starts = np.flatnonzero(word & (edge[at:at + len(part)] | ~np.concatenate(([False], word[:-1]))))
        if not len(starts):
            continue
        kept = part[word]
        heads = (np.cumsum(word) - 1)[starts]
        lengths = np.diff(np.append(heads, len(kept)))
        sums = crc.sums(kept, heads, lengths)
        rows = np.searchsorted(offsets, starts + at, side="right") - 1
        if open_length:
            sums[0] ^= crc.moved(np.array([open_sum]), lengths[:1])[0]
            lengths[0] += open_length
        # The last word may go on in the next block.
        open_sum, open_length, open_row = sums[-1], int(lengths[-1]), int(rows[-1])
        found.append((sums[:-1], lengths[:-1], rows[:-1]))
        if not word[-1]:
            close()
    close()
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((empty.astype(np.uint32), empty, empty), *found))


def buckets(crc: Crc, data: np.ndarray, offsets: np.ndarray, longest: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and row of every feature, words per row): the runs of 1 to `longest` words, joined by one space."""
    sums, lengths, rows = word_sums(crc, data, offsets)
    words = np.bincount(rows, minlength=len(offsets) - 1)
    run, run_lengths, run_rows = sums, lengths, rows
    out = [(crc.checksums(run, run_lengths) % np.uint32(count), run_rows)]
    for n in range(2, longest + 1):
        whole = rows[n - 1:] == rows[:len(rows) - n + 1]
        run = crc.joined(run[:len(rows) - n + 1], sums[n - 1:], lengths[n - 1:])
        run_lengths = run_lengths[:len(rows) - n + 1] + 1 + lengths[n - 1:]
        out.append((crc.checksums(run[whole], run_lengths[whole]) % np.uint32(count), rows[n - 1:][whole]))
    return np.concatenate([b for b, _ in out]).astype(np.int64), np.concatenate([r for _, r in out]), words


# --- counting, gains, drawing ---------------------------------------------------------------------


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 1, count: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts per bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, totals = Crc(), np.zeros(count, dtype=np.int64)
        for batch in batches:
            for group in slices(batch, 0):
                totals += np.bincount(buckets(crc, *utf8(group.column(0)), longest, count)[0], minlength=count)
        held = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(totals[held])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, count: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from the counts of both sides, in thousandths, floored."""
    s, t = (F.coalesce(F.col(c), F.lit(0)) for c in ("_s", "_t"))
    both = (raw.sparkSession.range(count).select(F.col("id").alias("bucket"))
            .join(raw.select("bucket", F.col("n").alias("_s")), "bucket", "left")
            .join(target.select("bucket", F.col("n").alias("_t")), "bucket", "left")
            .select("bucket", s.alias("_s"), t.alias("_t")))
    all_s, all_t = both.agg(F.sum("_s"), F.sum("_t")).first()
    ratio = ((F.col("_t") + 1).cast("double") * F.lit(float(all_s + count))
             / ((F.col("_s") + 1).cast("double") * F.lit(float(all_t + count))))
    return both.select("bucket", F.floor(F.lit(SCALE) * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_features, n_words, weight (the floored mean gain; 0 without features)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc = Crc()
        for batch in batches:
            for group in slices(batch, 1):
                found, rows, words = buckets(crc, *utf8(group.column(1)), longest, len(gain))
                features = np.bincount(rows, minlength=group.num_rows)
                total = np.zeros(group.num_rows, dtype=np.int64)
                np.add.at(total, rows, gain[found])
                weight = total // np.maximum(features, 1)
                yield pa.RecordBatch.from_arrays([group.column(0), *map(pa.array, (features.astype(np.int64), words.astype(np.int64), weight))],
                                                 names=["doc_id", "n_features", "n_words", "weight"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_features long, n_words long, weight long"))


def noise(id_col: str, seed: str) -> Column:
    """Gumbel noise of a hash of the id, in thousandths, floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    uniform = (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-SCALE) * F.log(-F.log(uniform))).cast("long")


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Adds rank, 1 for the first row of the order, without a window over all rows.

    Rows are dealt out by ranges of the order and sorted there, and a rank is the rows of the ranges before plus the place
    in the own one. Rows that the order doesn't tell apart are split by where they stood, so no key is hot.
    """
    place, part = spare(scored, "_place"), spare(scored, "_part")
    dealt = settled(
        scored.withColumn(part, F.monotonically_increasing_id())
        .repartitionByRange(*order, F.col(part)).sortWithinPartitions(*order, F.col(part))
        .withColumn(place, F.monotonically_increasing_id()).drop(part), "ranges")
    # The upper bits of a row's place are its partition, the lower 33 its number there.
    numbered = dealt.withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition.
    sizes = numbered.groupBy(part).count()
    before = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias("_before"))
    return (numbered.join(F.broadcast(before), part)
            .withColumn("rank", F.col("_before") + F.col(place) + 1).drop(part, place, "_before"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             longest: int = 1, count: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score, rank (null unless drawn), all but the id long.

    Of the N documents with at least `min_words` words, floor(percent * N / 100) are drawn: the highest scores, ties to
    smaller ids, null ids first. Null and empty texts have no features, weight 0 and are never drawn unless `min_words` is 0.
    A null id takes the noise of the empty text. Repeated rows are rows of their own, with equal scores and ranks one
    behind the other. An empty table gives an empty result, an empty target an even distribution. Other columns are not read.
    """
    raw = settled(bucket_counts(docs, text_col, longest, count), "raw-counts")
    wanted = settled(bucket_counts(target, target_col, longest, count), "target-counts")
    gain = np.zeros(count, dtype=np.int64)
    # `count` rows, whatever the size of the tables.
    for bucket, value in gains(raw, wanted, count).collect():
        gain[bucket] = value
    scored = settled(weigh(docs, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise("doc_id", seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    placed = ranked(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_first()])
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.withColumn("rank", rank).select(columns).unionByName(rest.select(columns))
