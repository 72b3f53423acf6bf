"""The operators as pipeline stages: each takes documents and returns documents, so that its decisions take effect."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import langid
from emberlog.llm.common import ascii_lower, spare
from emberlog.llm.exact_dedup import exact_dedup
from emberlog.llm.minhash import near_dedup
from emberlog.llm.mixing import WORD, mix
from emberlog.llm.packing import pack
from emberlog.session import settled


def _text_key() -> Column:
    """Digest of the normalised text, which tells rows of a repeated doc_id apart."""
    return F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))).cast("binary"), 256)


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text) is in `chosen` (doc_id, _key); rows that repeat both come once.

    Only rows whose id and text repeat go through the grouping that leaves one of them.
    """
    key, ident = spare(docs, "_key"), spare(docs, "_id")
    rows = docs.withColumn(key, _text_key())
    one = settled(chosen.groupBy(F.col("doc_id").alias(ident), F.col("_key").alias(key)).agg(F.max("_copies").alias("_copies")), "chosen")
    on = rows["doc_id"].eqNullSafe(one[ident]) & (rows[key] == one[key])
    kept = rows.join(one.filter("_copies = 1"), on, "left_semi").select(docs.columns)
    several = one.filter("_copies > 1")
    if several.isEmpty():
        return kept
    repeated = rows.join(several, rows["doc_id"].eqNullSafe(several[ident]) & (rows[key] == several[key]), "left_semi")
    return kept.unionByName(repeated.dropDuplicates(["doc_id", key]).select(docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: without a letter, or far from every language.

    The model is learned from the stage's own documents and their given languages; without any, nothing can be far
    from them, and only documents without a letter go.
    """
    model = langid.fit(docs)
    if model is None:
        letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
        return docs.filter(letter)
    # The columns go through under names of their own, which clash with none of the results.
    own = {f"_c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*own)
    text = next(c for c, name in own.items() if name == "text")
    told = langid.identify(rows, model, list(own), text_col=text)
    return told.filter("not rejected").select(*[F.col(c).alias(name) for c, name in own.items()])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each text: the one of largest doc_id."""
    found = settled(exact_dedup(docs), "exact")
    key = ["doc_id", "text_sha256"]
    copies = found.groupBy(*key).agg(F.count("*").alias("_copies"), F.max(F.col("kept").cast("int")).alias("_kept"))
    return _chosen(docs, copies.filter("_kept = 1").select("doc_id", F.col("text_sha256").alias("_key"), "_copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group linked by five-word shingles at a similarity of 0.8: the one of smallest doc_id."""
    rows = docs.select("doc_id", "text", _text_key().alias("_key"))
    found = settled(near_dedup(rows, carry=["_key"], group="_group").filter("kept"), "near")
    # Several texts of a group can carry the smallest id; the first digest stays. Kept rows of a group share their id.
    worded = found.filter("n_shingles > 0").groupBy("_group", "doc_id").agg(F.min("_key").alias("_key")).select("doc_id", "_key")
    bare = found.filter("n_shingles = 0").select("doc_id", "_key").distinct()
    chosen = worded.unionByName(bare)
    copies = found.groupBy("doc_id", "_key").agg(F.count("*").alias("_copies"))
    same = copies["doc_id"].eqNullSafe(chosen["doc_id"]) & (copies["_key"] == chosen["_key"])
    return _chosen(docs, copies.join(chosen, same, "left_semi"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts and drops documents so that sources come to their target weights.

    A document of which t words are taken comes t // size times whole and once more as the first t % size words,
    with the white space before and between them; n_chars follows the text.
    """
    key, ident, taken, size = (spare(docs, n) for n in ("_key", "_id", "_taken", "_size"))
    rows = docs.withColumn(key, _text_key())
    share = settled(mix(rows, carry=[key]).groupBy(F.col("doc_id").alias(ident), key, F.col("size").alias(size))
                    .agg(F.max("taken").alias(taken)).filter(F.col(taken) > 0), "share")
    share = share.withColumnRenamed(key, f"{key}_of")
    joined = rows.join(share, rows["doc_id"].eqNullSafe(share[ident]) & (rows[key] == share[f"{key}_of"]))
    whole, part = F.floor(F.col(taken) / F.col(size)).cast("int"), (F.col(taken) % F.col(size)).cast("int")
    words = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.greatest(part, F.lit(1))), "")
    texts = F.concat(F.array_repeat("text", whole), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    text = spare(joined, "_text")
    out = [F.col(text).alias("text") if c == "text"
           else F.char_length(text).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.withColumn(text, F.explode(texts)).select(*out)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
