"""Exact deduplication by deterministic block naming.

The normalised text (A-Z lower-cased, null as empty) is cut into blocks of a fixed number of bytes.
Equal blocks get one integer name: rows are dealt out by block, each partition is sorted, and a name is
the position of the first row of its run. Adjacent names are then named as pairs, again and again, until
every document has one name. Two documents have the same (number of rounds, name) exactly when their
texts are equal: no step relies on a hash being free of collisions.

Text is shuffled once. A key that very many rows share is found beforehand from counts of its hash and
dealt out under several salts; the few salted runs of a hot key are then given their least name. Hashes
only decide where rows go. Everything is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import HOT_ROWS, HOT_SHARE, ascii_lower, meet
from emberlog.session import settled

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Tasks that a hot key is dealt out to.
SALTS = 128


def hot_keys(hashes: DataFrame, column: str) -> DataFrame:
    """Values of `column` that many rows share, at most HOT_SHARE of them, fit to broadcast."""
    counts = settled(hashes.groupBy(column).agg(F.count("*").alias("_n")), "hot")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // HOT_SHARE))
    return F.broadcast(counts.filter(F.col("_n") >= least).select(column, F.lit(True).alias("_hot")))


def named(rows: DataFrame, keys: list[str], again: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and a `_name` that rows share exactly when their keys are equal.

    `again` gives the same keys in a cheaper form, for counting; rows need a column `_rid` to be salted by.
    """
    by_hash = F.xxhash64(*keys)
    hot = hot_keys(again.select(by_hash.alias("_h")), "_h")
    salt = F.when(F.col("_hot"), F.pmod(F.col("_rid"), F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    run = Window.partitionBy(*keys, "_salt")
    runs = settled(
        rows.withColumn("_h", by_hash).join(hot, "_h", "left").withColumn("_salt", salt)
        .select(*keep, *keys, "_salt")
        .repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt")
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.min("_at").over(run))
        .withColumn("_first", F.col("_at") == F.col("_part"))
        # Only the first row of a run of a hot key keeps its key, to be matched with the other runs.
        .select(*keep, "_part", *[F.when(F.col("_first") & (F.col("_salt") >= 0), F.col(k)).alias(k) for k in keys],
                (F.col("_first") & (F.col("_salt") >= 0)).alias("_lead")), "names")
    same = Window.partitionBy(*keys)
    merged = (runs.filter("_lead").select("_part", F.min("_part").over(same).alias("_least"))
              .filter("_part != _least"))
    return (runs.join(merged, "_part", "left")
            .select(*keep, F.coalesce("_least", "_part").alias("_name")))


def _blocks(raw: Column, length: Column, size: int) -> Column:
    # The last block is the rest; an empty text is one empty block.
    last = F.greatest(F.ceil(length / F.lit(size)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
        i.alias("_i"), F.substring(raw, i * size + 1, F.lit(size)).alias("_block")))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_rid, doc_id, text_sha256, _level, _name) of every row; equal texts share (_level, _name)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    # Text goes to binary, where a slice costs only its own bytes.
    raw = texts.select("doc_id", F.monotonically_increasing_id().alias("_rid"), F.col("_t").cast("binary").alias("_raw"))
    cut = _blocks(F.col("_raw"), F.octet_length("_raw"), block_bytes)
    rows = (raw.select("doc_id", "_rid", F.sha2("_raw", 256).alias("text_sha256"), cut.alias("_cut"))
            .withColumn("_m", F.size("_cut").cast("long"))
            .select("doc_id", "_rid", "text_sha256", "_m", F.inline("_cut"))
            .withColumn("_i", F.col("_i").cast("long"))
            # What describes the document travels with its first block only.
            .withColumn("doc_id", F.when(F.col("_i") == 0, F.col("doc_id")))
            .withColumn("text_sha256", F.when(F.col("_i") == 0, F.col("text_sha256"))))
    again = raw.select(F.explode(F.transform(cut, lambda b: b["_block"])).alias("_block"))
    keep = ["_rid", "_i", "_m", "doc_id", "text_sha256"]
    level = 0
    current = settled(named(rows, ["_block"], again, keep), "level")
    done: list[DataFrame] = []
    while True:
        done.append(current.filter("_m = 1").select("_rid", "doc_id", "text_sha256", F.lit(level).alias("_level"), "_name"))
        longer = current.filter("_m > 1")
        if longer.isEmpty():
            break
        odd = F.col("_i") % 2 == 1
        pairs = settled(
            longer.groupBy("_rid", F.floor(F.col("_i") / 2).alias("_i")).agg(
                F.max(F.when(~odd, F.col("_name"))).alias("_left"),
                F.coalesce(F.max(F.when(odd, F.col("_name"))), F.lit(-1).cast("long")).alias("_right"),
                F.max(F.floor((F.col("_m") + 1) / 2)).alias("_m"),
                F.max("doc_id").alias("doc_id"), F.max("text_sha256").alias("text_sha256")), "pairs")
        current = settled(named(pairs, ["_left", "_right"], pairs, keep), "level")
        level += 1
    return reduce(DataFrame.unionByName, done)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays; null ids count as smallest, and among rows
    that repeat the largest id too, one stays. Null and empty texts are equal. An empty table gives an empty
    result; other columns of the input are not read, whatever their names.
    """
    members = settled(identities(docs, id_col, text_col, block_bytes), "members")
    best = F.max(F.struct("doc_id", (-F.col("_rid")).alias("_r"))).alias("_best")
    groups = settled(members.groupBy("_level", "_name").agg(best, F.count("*").alias("group_size")), "groups")
    joined = meet(members, groups, ["_level", "_name"], "group_size")
    return joined.select("doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size",
                         (F.col("_rid") == -F.col("_best._r")).alias("kept"), "text_sha256")
