"""Bitemporal claim history: closing versions, and as-of queries for one or many coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

KEY = ["subject", "predicate"]


def history(claims: DataFrame, order: list[str]) -> DataFrame:
    """Adds seq within (subject, predicate), known_end, and the status that a later version leaves.

    A version is closed at the start of the next one's knowledge. A next version with an unknown
    start supersedes it but leaves it open.
    """
    w = Window.partitionBy(*KEY).orderBy(*order)
    following = F.lead("known_start").over(w)
    has_next = F.lead(F.lit(1)).over(w).isNotNull()
    return (
        claims.withColumn("seq", (F.row_number().over(w) - 1).cast("long"))
        .withColumn("known_end", following)
        .withColumn("version_status", F.when(has_next, F.lit("Superseded")).otherwise(F.col("status")))
    )


def qualifies(valid_at, known_at):
    return X.contains(F.col("valid_start"), F.col("valid_end"), valid_at) & X.contains(F.col("known_start"), F.col("known_end"), known_at)


def as_of(versions: DataFrame, valid_at: int, known_at: int) -> DataFrame:
    """Per key the latest version that held at valid_at as known at known_at; the coordinates are echoed."""
    rest = [c for c in versions.columns if c not in KEY]
    found = versions.where(qualifies(F.lit(valid_at), F.lit(known_at))).groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("v"))
    return found.select(*KEY, "v.*", F.lit(valid_at).alias("valid_at"), F.lit(known_at).alias("known_at"))


def as_of_batch(versions: DataFrame, coordinates: DataFrame) -> DataFrame:
    """As as_of() for a table of (subject, predicate, valid_at, known_at): an equality join with range conditions."""
    rest = [c for c in versions.columns if c not in KEY]
    at = [*KEY, "valid_at", "known_at"]
    joined = versions.join(coordinates.distinct(), KEY).where(qualifies(F.col("valid_at"), F.col("known_at")))
    return joined.groupBy(*at).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*at, "v.*")
