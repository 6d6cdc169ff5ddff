"""Backup manifests and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, state) of every file that differs: missing, extra, or changed."""
    e = expected.select("path", F.col("bytes").alias("e_bytes"), F.col("digest").alias("e_digest"))
    a = actual.select("path", F.col("bytes").alias("a_bytes"), F.col("digest").alias("a_digest"))
    state = (
        F.when(F.col("a_digest").isNull(), F.lit("missing"))
        .when(F.col("e_digest").isNull(), F.lit("extra"))
        .when((F.col("e_digest") != F.col("a_digest")) | (F.col("e_bytes") != F.col("a_bytes")), F.lit("changed"))
    )
    return e.join(a, "path", "full_outer").select("path", state.alias("state")).where(F.col("state").isNotNull())


def retention(backups: DataFrame, minimum: int, recent_after: int) -> DataFrame:
    """Adds decision: held, then the newest copies up to a minimum, then recent ones; the rest is pruned."""
    w = Window.partitionBy("root").orderBy(F.desc("created"), "backup")
    decision = (
        F.when(F.col("held"), F.lit("keep: held"))
        .when(F.col("newest") <= minimum, F.lit("keep: minimum copies"))
        .when(F.col("created") >= recent_after, F.lit("keep: recent"))
        .otherwise(F.lit("prune"))
    )
    return backups.withColumn("newest", F.row_number().over(w)).withColumn("decision", decision)


def newest(backups: DataFrame) -> DataFrame:
    w = Window.partitionBy("root").orderBy(F.desc("created"), "backup")
    return backups.withColumn("newest", F.row_number().over(w)).where("newest = 1").drop("newest")


def known_answers(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Compares answers by key, nulls equal to nulls."""
    both = expected.join(actual, "path", "left")
    return both.select("path", F.col("digest").eqNullSafe(F.col("actual_digest")).alias("same"))


def percentiles(samples: DataFrame, by: str, value: str) -> DataFrame:
    """Number, median, 95th and 99th percentile (interpolated) of a value by group."""
    at = lambda p: F.percentile(value, F.lit(p))
    return samples.groupBy(by).agg(F.count(value).alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
