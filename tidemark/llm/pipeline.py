"""The stages of the corpus pipeline: quality rules, exact and near deduplication, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents, and work on all rows.

Defined cases of every stage: null texts count as empty; rows that repeat an id are judged each by
its own text; nulls in other columns stay as they are; extra columns stay, whatever their names;
very long texts are looked at whole; an empty table gives an empty result. Quality: rows of a null
source share a host. Exact: of equal texts the longest original stays, of these the least id.
Near: of a component the least id stays. Mixing: a null source is a source of its own, and equal
places can't be. Encoding: rows that repeat an id share the first of its places.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, mixing, quality_rules, sentencepiece_nbest, simhash
from tidemark.llm.common import ensure_checkpoint_dir, id_of, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, laid out in the order of the mixture. The columns stay, so encode() looks the places up again."""
    return mixing.ordered(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids, number and score of the best segmentation, whether decoding restores the text, and
    mix_rank, the document's place in the mixture (from 0)."""
    encoded = sentencepiece_nbest.encode(docs).select("doc_id", "ids", "n_pieces", "score", "restored")
    ranks = mixing.places(docs)
    joined = encoded.join(ranks, id_of(encoded["doc_id"]) == id_of(ranks["mixed_id"]), "left")
    return joined.select(*[encoded[c] for c in encoded.columns], ranks["mix_rank"])


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near dedup", near),
    ("mixing to target weights", mix),
    ("sentencepiece encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; each result goes through a table in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return docs
