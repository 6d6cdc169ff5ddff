"""The registered queries of the corpus operators, one thin function each, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    exact_dedup,
    html_extraction,
    language_id,
    mixing,
    pipeline,
    quality_rules,
    repeats,
    sentencepiece_nbest,
    simhash,
    token_counts,
    toxicity,
)
from tidemark.llm.common import read
from tidemark.llm.sql import OP5_SQL, OP7_SQL


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentation's figures, and of each of the n best its length and the digest of its ids, best first."""
    encoded = sentencepiece_nbest.encode(read(spark, sf_dir, "documents"), digests=True)
    return encoded.select("doc_id", "n_pieces", "score", "scores", "restored", F.col("n_best_sha256")[0].alias("ids_sha256"), "n_best_pieces", "n_best_sha256")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(read(spark, sf_dir, "pages"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def _remainder(n: int):
    """crc32 of the id as text, modulo n: the fold that a row belongs to."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = _remainder(3) == 1
    model = language_id.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(4) == 2
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_simhash": op2_simhash,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_html_extraction": op4_html_extraction,
        "op5_mixing": op5_mixing,
        "op6_language_id": op6_language_id,
        "op7_repeats": op7_repeats,
        "op8_token_counts": op8_token_counts,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op1_exact_dedup": OP1_SQL, "op5_mixing": OP5_SQL, "op7_repeats": OP7_SQL, "op9_quality_rules": OP9_SQL}
    if pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""

OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams) WHERE c > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
failures AS (
  SELECT source, unnest([
    {rule: 'few', failed: n_words < 10}, {rule: 'repeats', failed: 100 * n_repeat_words > 20 * n_words}, {rule: 'symbols', failed: 10 * n_symbols > n_words},
    {rule: 'lines', failed: 10 * n_dup_lines > 3 * n_lines}, {rule: 'letters', failed: 2 * word_chars < 3 * n_words}], recursive := true) FROM b),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (failed) AS k FROM failures GROUP BY ALL),
moments AS (SELECT rule, avg(k / n) AS m, var_pop(k / n) AS raw, avg(1 / n) AS w FROM h GROUP BY rule),
p AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1e-6) ELSE 1e6 END AS s, greatest(0.5, least(m + 1.645 * sqrt(v), 0.9)) AS top
  FROM (SELECT rule, m, CASE WHEN w < 1 THEN greatest((raw - m * (1 - m) * w) / (1 - w), 0) ELSE 0 END AS v FROM moments)),
bad AS (SELECT DISTINCT source FROM h JOIN p USING (rule) WHERE (k + m * s) / (n + s) > top)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       bad.hit IS NOT NULL AS host_refused, NOT base_failed AND bad.hit IS NULL AS kept
FROM b LEFT JOIN (SELECT source AS host, true AS hit FROM bad) AS bad ON b.source IS NOT DISTINCT FROM bad.host
"""
