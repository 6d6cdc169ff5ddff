"""Refs, snapshots and commit-filtered reads over append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ref_state(edits: DataFrame) -> DataFrame:
    """(kind, name, target): branches and tags after folding the edits, the last write of each ref counting.

    edits: (seq, event_id, op, name, target). A removed ref has no row.
    """
    kind = F.when(F.col("op").isin("CreateBranch", "SetHead", "RemoveBranch"), F.lit("branch")).when(F.col("op").isin("SetTag", "RemoveTag"), F.lit("tag"))
    refs = edits.withColumn("kind", kind).where(F.col("kind").isNotNull())
    last = refs.groupBy("kind", "name").agg(F.max_by(F.struct("op", "target"), F.struct("seq", "event_id")).alias("last"))
    return last.where(~F.col("last.op").startswith("Remove")).select("kind", "name", F.col("last.target").alias("target"))


def gc_roots(state: DataFrame) -> DataFrame:
    return state.select(F.col("target").alias("commit")).distinct()


def latest(records: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The last version of each key; tombstones (op 'del') are dropped."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return records.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").where(F.col("op") != "del")


def as_of_commit(records: DataFrame, seq: int) -> DataFrame:
    """Records of the chain up to a commit: a filter that reaches the scan."""
    return records.where(F.col("seq") <= seq)


def prefix_upper(prefix: bytes) -> bytes | None:
    """The least key above all keys with the prefix, carrying over 0xFF; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None
