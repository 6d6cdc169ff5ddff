"""Columns whose names the operators use themselves must not matter."""

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, html_extraction, language_id, mixing, quality_rules, repeats, sentencepiece_nbest, simhash, token_counts, toxicity

NAMES = "kept_id keep_id group_size kept print n_bytes n_chars text_sha256 id bucket component component_id a b c u m mixed_id mix_rank slot rank key range block host n_words base_failed n h c1 c2 at before behind spans wanted toxic mark_id half score ids held_out page_id wrapper class rep_id same".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(f"w{i % 5}_{k}" for k in range(30)), "en", "s") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES]).cache()


def test_operators(spark, docs):
    assert exact_dedup.groups(docs).where("kept").count() == 5 and exact_dedup.deduplicate(docs).columns == docs.columns
    assert simhash.near_groups(docs).select("component_id").distinct().count() == 5 and simhash.deduplicate(docs).count() == 5
    assert mixing.mix(docs).count() == 12 and mixing.ordered(docs).columns == docs.columns
    assert quality_rules.judge(docs).where("kept").count() == 12
    assert sentencepiece_nbest.encode(docs).where("restored").count() == 12
    assert repeats.remove_repeats(docs).count() == 12 and token_counts.count(docs).count() == 12
    assert language_id.identify(docs, language_id.fit(docs)).count() == 12
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit(1).alias("text"))
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 12
    pages = docs.drop("page_id").select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"), "host", "wrapper", "h", "at", "slot")
    assert html_extraction.main_text(pages).count() == 12


def test_stages(spark, docs, tmp_path):
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
