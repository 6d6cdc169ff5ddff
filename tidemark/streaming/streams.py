"""Streaming forms: session read-sets, idempotent decisions, claim ingestion, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONSUMED = "session long, written string, parents string, label int"
STATE = "nodes string, label int"


def _consume(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Reads pile up in the state; a write takes them all and starts anew."""
    nodes, label = state.get if state.exists else ("", -1)
    held = [n for n in nodes.split(",") if n]
    out = []
    rows = pd.concat(list(batches)).sort_values("turn")
    for r in rows.itertuples():
        if r.is_write:
            out.append((key[0], r.node, ",".join(sorted(set(held))), max(label, int(r.label))))
            held, label = [], -1
        else:
            held.append(r.node)
            label = max(label, int(r.label))
    state.update((",".join(sorted(set(held))), label))
    if out:
        yield pd.DataFrame(out, columns=["session", "written", "parents", "label"])


def session_read_sets(events: DataFrame) -> DataFrame:
    """Stream of (session, turn, is_write, node, label) to one row per write with what its session had read.

    A session's events must arrive in the order of turns from batch to batch.
    """
    return events.groupBy("session").applyInPandasWithState(_consume, CONSUMED, STATE, "append", "NoTimeout")


def first_decisions(proposals: DataFrame) -> DataFrame:
    """The first proposal of each idempotency key. The first decision on a key is final, so no key is ever forgotten:
    the state has an entry for each key, which a state store on disk (RocksDB) holds."""
    return proposals.dropDuplicates(["idempotency_key"])


def append_claims(claims: DataFrame, path: str, checkpoint: str):
    """Appends late and early claims alike to a history: both time axes are data, so nothing is dropped as late.
    A batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return claims.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Extension: counts and totals by event type over tumbling windows under a watermark."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )
