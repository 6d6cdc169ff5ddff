"""Ingest and export through Spark's own readers and writers: batches of observations from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions import schema as S

FORMATS = ("parquet", "json", "csv", "orc", "text")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | StructType | None = None, **options) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def observations(rows: DataFrame, key: Column, source: Column, payload: Column, trust: Column, ingested_at: Column, observed_at: Column | None = None) -> DataFrame:
    """Rows for a commit, each an observation; it asserts nothing by itself."""
    o = F.struct(source.alias("source"), trust.cast("tinyint").alias("trust"), (F.lit(None) if observed_at is None else observed_at).cast("bigint").alias("observed_at"), ingested_at.cast("bigint").alias("ingested_at"), payload.alias("payload"))
    typed = rows.sparkSession.createDataFrame([], S.WRITE)
    return rows.select(key.alias("key"), o.alias("observation"), F.lit(None).cast(typed.schema["claim"].dataType).alias("claim"), F.lit(None).cast(typed.schema["value"].dataType).alias("value"))


def values(rows: DataFrame, key: Column, kind: str, value: Column) -> DataFrame:
    """Rows for a commit, each a plain value of one kind: blob, counter, set, flag, text or number."""
    field = {"blob": "blob", "counter": "counter", "set": "members", "flag": "flag", "text": "body", "number": "number"}[kind]
    typed = rows.sparkSession.createDataFrame([], S.WRITE)
    kinds = typed.schema["value"].dataType
    parts = [F.lit(kind).alias("kind") if f.name == "kind" else (value if f.name == field else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]
    return rows.select(key.alias("key"), F.lit(None).cast(typed.schema["observation"].dataType).alias("observation"), F.lit(None).cast(typed.schema["claim"].dataType).alias("claim"), F.struct(*parts).alias("value"))


def claims(rows: DataFrame, key: Column, **columns: Column) -> DataFrame:
    """Rows for a commit, each a claim; columns by the names of schema.CLAIM, missing ones null."""
    typed = rows.sparkSession.createDataFrame([], S.WRITE)
    kinds = typed.schema["claim"].dataType
    if unknown := set(columns) - {f.name for f in kinds.fields}:
        raise ValueError(f"no such claim columns: {sorted(unknown)}")
    parts = [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]
    return rows.select(key.alias("key"), F.lit(None).cast(typed.schema["observation"].dataType).alias("observation"), F.struct(*parts).alias("claim"), F.lit(None).cast(typed.schema["value"].dataType).alias("value"))
