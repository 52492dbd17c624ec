"""The eleven registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, exact_search, language_model, licenses, line_dedup, near_dedup, packing, pii, quality
from .common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = byte_bpe.round_trip(read(spark, sf_dir, "documents"), path, pattern)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.views(read(spark, sf_dir, "conversations"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(read(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.detect(read(spark, sf_dir, "documents"))
    count = lambda kind: (F.size(F.split("base", f"{kind}:")) - 1).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), "q")
    return out.select("doc_id", *[f"q.{c}" for c in quality.BASE], "q.base_failed", "q.kept", "q.n_grams", "q.ratio")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op7_quality_rules`` and the verdict they give by themselves, which SQL can express."""
    return op7_quality_rules(spark, sf_dir).select("doc_id", *quality.BASE, "base_failed")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of ``op6_pii`` that SQL can express: addresses in the patterns' order, numbers by their digits."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_phone")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_docs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (quality_base, pii_base, op1_packing, op2_byte_bpe, op3_chat_format, op4_exact_top_k, op5_language_model, op6_pii, op7_quality_rules, op8_license_scan, op9_line_dedup, op10_near_dedup)
}
ORACLE_SQL: dict[str, str] = {
    "quality_base": r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: [w[k], w[k + 1], w[k + 2]])) AS g FROM w WHERE len(w) > 2),
twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + o) AS n FROM grams JOIN twice USING (r, g) CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
counted AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
""",
    "pii_base": r"""
WITH found AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') AS email,
         regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+') AS ip,
         regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') AS phone
  FROM documents)
SELECT doc_id, coalesce(len(email), 0) AS n_email,
       coalesce(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: CAST(y AS HUGEINT) > 255)) = 0)), 0) AS n_ip,
       coalesce(len(list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)), 0) AS n_phone
FROM found
""",
    "op3_chat_format": chat.ORACLE_SQL,
    "op4_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.e, p.e) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op9_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN repeated USING (key)
GROUP BY doc_id
""",
}
