"""The registered queries of the operators, each next to the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import ann, langid, lm, toxicity
from emberlog.llm.byte_bpe import digests
from emberlog.llm.common import remainder, table
from emberlog.llm.exact_dedup import exact_dedup
from emberlog.llm.html_text import extract_text
from emberlog.llm.importance import resample
from emberlog.llm.minhash import near_dedup
from emberlog.llm.mixing import mix
from emberlog.llm.packing import pack
from emberlog.llm.token_count import token_counts
from emberlog.llm.turns import audit_conversations, damaged

Query = Callable[[SparkSession, str], DataFrame]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    model = lm.fit(docs.filter("not held_out"))
    return lm.score(docs, model, ["doc_id", "held_out"])


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    model = toxicity.fit(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.filter("not held_out"))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, num=85, den=100)


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP8_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '-')), 1, 15))::bigint AS seed
  FROM documents
), sources AS (
  SELECT source, sum(size)::bigint AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows GROUP BY source
), levels AS (
  SELECT *, 3 * source_size / weight AS fill,
         ((sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::bigint
          / (sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::bigint) AS level
  FROM sources
), targets AS (
  SELECT source, source_size, least(4096, greatest(ceil(source_size / 250000), 1))::bigint AS shards,
         CASE WHEN open_level IS NULL OR fill <= open_level THEN 3.0::double * source_size ELSE weight * open_level END AS target
  FROM levels, (SELECT min_by(level, fill) AS open_level FROM levels WHERE fill > level)
), source_seats AS (
  SELECT source, target / (2 * k + 1) AS quotient, k
  FROM (SELECT source, target, unnest(range(3 * ceil(source_size / 32)::bigint)) AS k FROM targets)
), source_quotas AS (
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, k) AS place FROM source_seats)
  WHERE place <= (SELECT round(sum(target) / 32) FROM targets) GROUP BY source
), dealt AS (
  SELECT r.*, t.source_size, t.target, coalesce(q.quota, 0) AS source_quota, r.seed % t.shards AS shard
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN source_quotas q ON r.source IS NOT DISTINCT FROM q.source
), cells AS (
  SELECT source, shard, source_quota, sum(size)::bigint AS tokens, ceil(sum(size) / 32)::bigint AS n FROM dealt GROUP BY ALL
), cell_seats AS (
  SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY tokens / (2 * k + 1) DESC, shard, k) AS place
  FROM (SELECT *, unnest(range(3 * n)) AS k FROM cells)
), quotas AS (
  SELECT c.source, c.shard, greatest(c.n, 1) AS n, coalesce(q.quota, 0) AS quota,
         ('0x' || substr(md5('mix-1|shift|' || coalesce(c.source, '-') || '|' || c.shard), 1, 15))::bigint % greatest(c.n, 1) AS shift
  FROM cells c LEFT JOIN (SELECT source, shard, count(*) AS quota FROM cell_seats WHERE place <= source_quota GROUP BY ALL) q
    ON c.source IS NOT DISTINCT FROM q.source AND c.shard = q.shard
), placed AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY d.source, d.shard ORDER BY seed, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start,
         q.n, q.quota, q.shift, row_number() OVER () AS line
  FROM dealt d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source AND d.shard = q.shard
), picked AS (
  SELECT line, sum(least(start + size, 32 * (j + 1)) - greatest(start, 32 * j)) AS words
  FROM (SELECT *, unnest(range(start // 32, (start + size - 1) // 32 + 1)) AS j FROM placed WHERE size > 0)
  WHERE (j * (2147483647 % n) + shift) % n < quota % n GROUP BY line
)
SELECT doc_id, size, source_size, target, (size * (quota // n) + coalesce(words, 0))::bigint AS taken
FROM placed LEFT JOIN picked USING (line)
"""

OP9_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

#: The register of CRC-32 after one byte, by the low byte of the register before it.
CRC_STEPS = """
steps AS (
  SELECT list(c ORDER BY i) AS step FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
)"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text, from its bytes and the column `step`."""
    code = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {code}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = rf"""
WITH {CRC_STEPS.strip()}, texts AS (
  SELECT 'doc' AS side, row_number() OVER () AS line, doc_id, text FROM documents
  UNION ALL SELECT 'target', 0, NULL, text FROM benchmark
), words AS (
  SELECT side, line, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM texts
), codes AS (
  SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM words), steps
), counts AS (
  SELECT r.bucket, count(*) FILTER (side = 'doc') AS s, count(*) FILTER (side = 'target') AS t
  FROM range(10000) r(bucket) LEFT JOIN (SELECT side, bucket FROM words JOIN codes USING (word)) f ON r.bucket = f.bucket GROUP BY r.bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::double * (sum(s) OVER () + 10000)::double / ((s + 1)::double * (sum(t) OVER () + 10000)::double)))::bigint AS gain FROM counts
), weights AS (
  SELECT line, count(*) AS n, sum(gain)::bigint AS total FROM words JOIN codes USING (word) JOIN gains USING (bucket) WHERE side = 'doc' GROUP BY line
), scores AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE total // n - (total % n < 0)::bigint END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint AS h
  FROM texts LEFT JOIN weights USING (line) WHERE side = 'doc'
), scored AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM scores
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
             count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
"""

OP12_SQL = rf"""
WITH RECURSIVE {CRC_STEPS.strip()}, coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("key")} % 20 AS code
  FROM (SELECT *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations), steps
), rows AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM coded WHERE code <> 0
), placed AS (
  SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS previous, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)
), faulty AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen AS duplicate, bare <> '' AND NOT seen AND bare[-1] NOT IN ('.', '!', '?') AS truncated,
         previous IS NOT NULL AND previous || role[1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), totals AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM faulty GROUP BY conv_id
), arrows(origin, letter, goal) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')
), leaps(origin, goal, cost, edits) AS (
  -- Up to two insertions in a row; more would return to a state already passed.
  SELECT origin, origin, 0, '' FROM (SELECT DISTINCT origin FROM arrows)
  UNION ALL SELECT origin, goal, 2, 'I' FROM arrows WHERE letter <> 's'
  UNION ALL SELECT a.origin, b.goal, 4, 'II' FROM arrows a JOIN arrows b ON a.goal = b.origin WHERE a.letter <> 's'
), moves AS (
  SELECT f.conv_id, f.i, s.origin, s.origin AS goal, 3 + 0 AS cost, 'D' AS edit FROM faulty f, (SELECT DISTINCT origin FROM arrows) s
  UNION ALL
  SELECT f.conv_id, f.i, a.origin, a.goal, (CASE WHEN f.role[1] = a.letter THEN 0 ELSE 2 END) + f.truncated::int, CASE WHEN f.role[1] = a.letter THEN 'K' ELSE 'R' END
  FROM faulty f, arrows a WHERE NOT f.blank AND NOT f.duplicate AND (f.role[1] = a.letter OR a.letter <> 's')
), walk AS (
  SELECT conv_id, 0::bigint AS i, goal AS state, {{'cost': cost::bigint, 'audit': edits}} AS best FROM totals, leaps WHERE origin = ''
  UNION ALL
  SELECT w.conv_id, w.i + 1, l.goal, min({{'cost': w.best.cost + m.cost + l.cost, 'audit': w.best.audit || m.edit || l.edits}})
  FROM walk w JOIN moves m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1 AND m.origin = w.state JOIN leaps l ON l.origin = m.goal
  GROUP BY w.conv_id, w.i, l.goal
), audits AS (
  SELECT t.conv_id, min(w.best) AS best FROM walk w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = t.n
  WHERE w.state IN ('', 'a') GROUP BY t.conv_id
), letters AS (
  SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM (SELECT conv_id, best.audit AS audit FROM audits)
), lined AS (
  SELECT conv_id, p, audit[p] AS edit, count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters
), kept AS (
  SELECT l.conv_id, l.p, l.edit, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS q,
         max(CASE WHEN l.edit = 'K' AND f.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS system
  FROM lined l LEFT JOIN faulty f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i AND l.edit <> 'I' WHERE l.edit <> 'D'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (q - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY q)) AS repaired_sha256
  FROM kept GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(a.best.cost, 0) AS cost, coalesce(a.best.audit, '') AS audit, coalesce(r.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON c.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN audits a ON c.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON c.conv_id IS NOT DISTINCT FROM r.conv_id
"""

QUERIES: dict[str, Query] = {
    "op1_lm_score": op1_lm_score,
    "op2_nearest": op2_nearest,
    "op3_toxicity": op3_toxicity,
    "op4_pack": op4_pack,
    "op5_token_counts": op5_token_counts,
    "op6_html_text": op6_html_text,
    "op7_language_id": op7_language_id,
    "op8_mix": op8_mix,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_resample": op11_resample,
    "op12_repair": op12_repair,
    "op13_byte_bpe": op13_byte_bpe,
}
ORACLES: dict[str, str] = {
    "op8_mix": OP8_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_resample": OP11_SQL,
    "op12_repair": OP12_SQL,
}
