"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import hmm, mixing, neighbours, packing, quality, rollup, sharding, simhash, toxicity, warc
from voxloom.llm.common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the pages have no time of capture: a second for each id
    pages = table(spark, sf_dir, "pages")
    index = warc.archive_pages(pages, time=F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")))
    base = (~quality.passes("base-1")).alias("base_failed")
    return rows.select("doc_id", *quality.MEASURES[:5], base, "kept", "fail_bits")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup_by_batches(table(spark, sf_dir, "documents"), shared_path(spark, "rollup")).totals()


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_by_source(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_token_counts": op6_token_counts,
    "op7_language_model": op7_language_model,
    "op8_neighbours": op8_neighbours,
    "op9_simhash": op9_simhash,
    "op10_mixing": op10_mixing,
}

WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op4_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest""",
    "op5_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws
  FROM documents),
words AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
windows AS (
  SELECT rid, i, w, lead(w, 1) OVER p AS w1, lead(w, 2) OVER p AS w2 FROM words
  WINDOW p AS (PARTITION BY rid ORDER BY i)),
twice AS (
  SELECT rid, i FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL)
  WHERE n > 1),
inside AS (
  SELECT rid, count(DISTINCT pos) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS pos FROM twice) GROUP BY rid),
m AS (
  SELECT d.rid, doc_id, len(ws) AS n_words,
         length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN inside ON inside.rid = d.rid),
r AS (
  SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM m),
b AS (
  SELECT *, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 10 * n_symbols > n_words AS b2,
         2 * n_dup_lines > n_lines AS b3, word_chars < 3 * n_words AS b4, word_chars > 12 * n_words AS b5
  FROM r)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       b0 OR b1 AS base_failed, NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept,
       (b0::BIGINT + 2 * b1::BIGINT + 4 * b2::BIGINT + 8 * b3::BIGINT + 16 * b4::BIGINT + 32 * b5::BIGINT)::BIGINT AS fail_bits
FROM b""",
    "op10_mixing": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT] AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER q AS place,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM s WINDOW q AS (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, source)),
f AS (SELECT min(place) AS place FROM o WHERE NOT rest * weight / weights > 2 * source_size),
l AS (SELECT o.rest, o.weights, o.place FROM o JOIN f ON o.place = f.place),
t AS (
  SELECT o.source, o.source_size,
         CASE WHEN l.place IS NULL OR o.place < l.place THEN 2.0::DOUBLE * o.source_size ELSE l.rest * o.weight / l.weights END AS target
  FROM o LEFT JOIN l ON true),
q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
c AS (
  SELECT doc_id, size, source_size, target, least(quota, 2 * source_size) AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || size), doc_id
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       ((quota // greatest(source_size, 1)) * size
        + greatest(0, least(size, quota % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM c""",
}
