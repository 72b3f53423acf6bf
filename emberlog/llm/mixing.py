"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from weights, with a ceiling of three times a source's size. Blocks of BLOCK_TOKENS tokens are
then given out one by one to the highest quotient target / (2k + 1), first among sources and then among the
shards of a source, which leaves an integer quota per shard. A shard is a seeded hash bucket of a source;
its documents stand in a seeded order, their tokens are cut into blocks, and a seeded permutation of the
block numbers picks the quota's blocks. A document is taken as far as picked blocks cover it.

A highest-quotient allocation equals, for some divisor, rounding every claim / divisor to the nearest
integer, so only quotients near the boundary are compared, not one per block. No step shuffles text, and a
hot source is as many tasks as it has shards. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.session import settled

BLOCK_TOKENS = 32
#: Tokens of a shard; a source has at most MOST_SHARDS shards, which then are larger.
SHARD_TOKENS, MOST_SHARDS = 250_000, 4096
#: No source and no document is taken more often.
MOST_COPIES = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: A prime above any number of blocks of a shard, so that multiplying by it permutes the block numbers.
STRIDE = 2_147_483_647


def seeded(*parts: Column | str) -> Column:
    """60 bits of an md5 of the seed and the parts, as a long that SQL engines agree on."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size); weights 1, 2, 3, 1, .. by code point, null last.

    With sources ordered by ceiling / weight, those that reach their ceiling come first; the others share the
    rest by weight. One row per source passes through one task here.
    """
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    full_first = everything.orderBy("_fill", F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    onward = full_first.rowsBetween(0, Window.unboundedFollowing)
    ranked = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
              .withColumn("_weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
              .withColumn("_top", F.col("source_size") * MOST_COPIES)
              .withColumn("_fill", F.col("_top") / F.col("_weight"))
              .withColumn("_all", F.sum("source_size").over(everything))
              .withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_top").over(before), F.lit(0)))
                          / F.sum("_weight").over(onward))
              # The first source that is not filled sets the level for all from there on.
              .withColumn("_open", F.min(F.when(F.col("_fill") > F.col("_level"), F.struct("_fill", "_level"))).over(everything)))
    open_level = F.col("_open._level")
    target = F.when(open_level.isNull() | (F.col("_fill") <= open_level), F.col("_top").cast("double")) \
        .otherwise(F.col("_weight") * open_level)
    return ranked.select("source", "source_size", target.alias("target"))


def apportion(claims: DataFrame, total: Column, claim: str, ceiling: str, groups: list[str], key: list[Column]) -> DataFrame:
    """Adds `_quota`: `total` seats of each group given to the highest claim / (2k + 1), k seats held so far.

    Equal quotients go by `key`. No row gets more seats than `ceiling`.
    """
    group = Window.partitionBy(*groups)
    # Seats k whose quotient surely is above the boundary need no comparison: a row's seats differ from its
    # exact share by at most this margin, since the divisor that fits is that close to the exact one.
    share = F.col("_total") * F.col(claim) / F.col("_claims")
    margin = F.ceil(2 * share * F.col("_rows") / F.greatest(F.col("_total"), F.lit(1))).cast("long") + 3
    low = F.greatest(F.floor(share).cast("long") - margin, F.lit(0).cast("long"))
    rows = (claims.withColumn("_total", total)
            .withColumn("_claims", F.sum(claim).over(group)).withColumn("_rows", F.count("*").over(group))
            .withColumn("_sure", F.when(F.col(claim) > 0, F.least(low, F.col(ceiling))).otherwise(F.lit(0)))
            .withColumn("_last", F.when(F.col(claim) > 0, F.least(F.floor(share).cast("long") + margin, F.col(ceiling) - 1)).otherwise(F.lit(-1))))
    seats = F.when(F.col("_last") >= F.col("_sure"), F.sequence(F.col("_sure"), F.col("_last"))).otherwise(F.array().cast("array<bigint>"))
    order = group.orderBy((F.col(claim) / (F.col("_k") * 2 + 1)).desc(), *key, F.col("_k"))
    rows = rows.withColumn("_open", F.col("_total") - F.sum("_sure").over(group))
    won = (rows.withColumn("_k", F.explode_outer(seats))
           .withColumn("_place", F.when(F.col("_k").isNotNull(), F.row_number().over(order))))
    keep = [c for c in claims.columns]
    return (won.groupBy(*keep, "_sure").agg(F.count(F.when(F.col("_place") <= F.col("_open"), 1)).alias("_won"))
            .withColumn("_quota", F.col("_sure") + F.col("_won")).drop("_sure", "_won"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, and the columns `carry`.

    Size is the number of words. Null texts have none; a null source is a source of its own, last in order.
    Rows without words are taken 0 times, a table without words has targets of 0. Repeated rows count as rows of
    their own; rows that agree in id and size are interchangeable. Reruns agree.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    carry = carry or []
    rows = settled(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), *carry), "sizes")
    sources = settled(
        source_targets(rows)
        .withColumn("_shards", F.least(F.lit(MOST_SHARDS), F.greatest(F.ceil(F.col("source_size") / SHARD_TOKENS), F.lit(1))).cast("long")), "sources")
    # Blocks in all: as many as the words make. Claims below are in tokens, so any unit would do.
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / BLOCK_TOKENS).cast("long")
    ceiling = (F.ceil(F.col("source_size") / BLOCK_TOKENS) * MOST_COPIES).cast("long")
    by_source = apportion(sources.withColumn("_blocks", blocks).withColumn("_ceiling", ceiling),
                          F.col("_blocks"), "target", "_ceiling", [], [F.col("source").asc_nulls_last()])
    by_source = settled(by_source.select("source", "source_size", "target", "_shards", F.col("_quota").alias("_source_quota")), "quotas")
    dealt = settled(
        rows.join(by_source, rows["source"].eqNullSafe(by_source["source"]))
        .select("doc_id", *carry, rows["source"], "size", "source_size", "target", "_source_quota", "_shards")
        .withColumn("_seed", seeded("doc_id"))
        .withColumn("_shard", F.pmod(F.col("_seed"), F.col("_shards"))), "dealt")
    cell = ["source", "_shard"]
    cells = (dealt.groupBy(*cell, "source_size", "target", "_source_quota")
             .agg(F.sum("size").alias("_size")).withColumn("_n", F.ceil(F.col("_size") / BLOCK_TOKENS).cast("long"))
             .withColumn("_ceiling", F.col("_n") * MOST_COPIES))
    quotas = settled(
        apportion(cells, F.col("_source_quota"), "_size", "_ceiling", ["source"], [F.col("_shard")])
        .select(F.col("source").alias("_source"), F.col("_shard").alias("_cell"), "_n", F.col("_quota")), "cells")
    stand = Window.partitionBy(*cell).orderBy("_seed", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (dealt.withColumn("_from", F.coalesce(F.sum("size").over(stand), F.lit(0)))
              .join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_cell"))))
    return placed.select("doc_id", "size", "source_size", "target", taken().alias("taken"), *carry)


def taken() -> Column:
    """Words of a document (`_from`, `size`) in the picked blocks of its shard (`_n` blocks, `_quota` picked)."""
    n = F.greatest(F.col("_n"), F.lit(1))
    whole, extra = F.floor(F.col("_quota") / n).cast("long"), F.pmod(F.col("_quota"), n)
    shift = F.pmod(seeded(F.lit("shift"), "source", "_shard"), n)
    end = F.col("_from") + F.col("size")
    first = F.floor(F.col("_from") / BLOCK_TOKENS).cast("long")
    last = F.floor((end - 1) / BLOCK_TOKENS).cast("long")
    stride = F.lit(STRIDE).cast("long") % n

    def covered(acc: Column, j: Column) -> Column:
        overlap = F.least(end, (j + 1) * BLOCK_TOKENS) - F.greatest(F.col("_from"), j * BLOCK_TOKENS)
        return acc + F.when((j * stride + shift) % n < extra, overlap).otherwise(F.lit(0).cast("long"))

    picked = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), covered)
    return F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("size") * whole + picked)
