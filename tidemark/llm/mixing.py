"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed pseudo-random order and cut into blocks. The blocks
of a source with weight w are the subtasks of a Pfair task: block i (from 1) is released at slot
floor((i-1)/w) and due at ceil(i/w). Earliest deadline first over the released blocks gives every
block its slot, and after any number of slots t each source has had w*t blocks, less or more
than one block off.

Weights are exact rationals. Where all of them are whole numbers of slots out of a short period,
the schedule repeats and one period is simulated. Otherwise the whole run is simulated, block by
block: the driver holds one row for each block, a sixteenth of the documents' number. Documents
find their block by ranks that no task has to compute for a whole source: local ranks within hash
ranges, plus the sizes of the ranges before.

A source that has run out leaves its slots empty, and the others close ranks; so all rows are
kept, and up to the first exhaustion the deviation stays below one block. In a whole run a slot
left empty may go to a block that is released already.

Defined cases: a null source is a source of its own; texts are not looked at, whatever their
length; a null id is an id like any other; rows that repeat an id have a place each, in an order
that may be any among them, and stand next to each other if their source is the same; blocks that
are due at once go by the names of their sources, null first; sources without a weight share the
smallest given weight; a source of weight 0 stands after all others, and a negative weight is
refused; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, id_of

BLOCK = 16
#: Slots of a repeated period, at most, or ten for each source if that is more.
PERIOD = 1_000
#: Rows that one hash range of a source holds on average.
RANGE_ROWS = 4_000


def exact_quotas(weights: dict) -> dict:
    """The least whole numbers in the exact proportion of the weights."""
    if min(weights.values()) < 0 or not any(weights.values()):
        raise ValueError("weights must not be negative, nor all 0")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*[w.denominator for w in exact.values()])
    whole = {s: w.numerator * (scale // w.denominator) for s, w in exact.items()}
    common = math.gcd(*whole.values())
    return {s: n // common for s, n in whole.items()}


def quotas(weights: dict, period: int) -> dict:
    """Exact quotas, if they fit the period; else whole numbers of slots, at least one for each source, that sum
    to the period (largest remainders first). mix() only takes exact ones."""
    whole = exact_quotas(weights)
    if all(whole.values()) and sum(whole.values()) <= period:
        return whole
    total = sum(Fraction(w) for w in weights.values())
    spare = period - len(weights)
    exact = {s: Fraction(w) / total * spare for s, w in weights.items()}
    got = {s: 1 + math.floor(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (math.floor(exact[s]) - exact[s], s is not None, s or ""))
    for s in order[: period - sum(got.values())]:
        got[s] += 1
    return got


def schedule(quota: dict) -> list:
    """The source of each slot of one period: earliest deadline first over released blocks."""
    period = sum(quota.values())
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    waiting = [(0, k, 1) for k in range(len(names))]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slots = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * period // quota[names[k]]), k, i))
        due, k, i = heapq.heappop(ready)
        if due < now + 1:
            raise AssertionError("a block missed its deadline")
        slots.append(names[k])
        if i < quota[names[k]]:
            heapq.heappush(waiting, (i * period // quota[names[k]], k, i + 1))
    return slots


def run_schedule(quota: dict, n_blocks: dict) -> tuple[list, list[int], list[int], list[int]]:
    """(names, source, block, slot) of every block of the run, in the order of the slots; source is a place in names."""
    names = sorted(quota, key=lambda s: (s is not None, s or ""))
    period = sum(quota.values())
    share, left = [quota[s] for s in names], [n_blocks[s] for s in names]
    waiting = [(0, k, 1) for k in range(len(names)) if share[k] and left[k]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    sources: list[int] = []
    blocks: list[int] = []
    slots: list[int] = []
    now = 0
    while waiting or ready:
        if not ready and waiting[0][0] > now:
            now = waiting[0][0]
        while waiting and waiting[0][0] <= now:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * period // share[k]), k, i))
        due, k, i = heapq.heappop(ready)
        if due < now + 1:
            raise AssertionError("a block missed its deadline")
        sources.append(k)
        blocks.append(i - 1)
        slots.append(now)
        if i < left[k]:
            heapq.heappush(waiting, (i * period // share[k], k, i + 1))
        now += 1
    for k in (k for k in range(len(names)) if not share[k]):
        sources += [k] * left[k]
        blocks += range(left[k])
        slots += range(now, now + left[k])
        now += left[k]
    return names, sources, blocks, slots


def target_weights(counts: dict, temperature: float = 0.5) -> dict:
    """Weights in proportion to a power of the sources' sizes: evens out large and small sources."""
    return {s: Fraction(round(n**temperature * 1000) or 1) for s, n in counts.items()}


def mix(
    docs: DataFrame,
    weights: dict | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block: int = BLOCK,
    period: int = PERIOD,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, source, block, slot, and mix_rank, its place in the mixture (from 0)."""
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source")).withColumn("key", F.xxhash64("doc_id")))
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    found = {r["source"]: r["n"] for r in sizes.collect()}
    if not found:
        return rows.select("doc_id", "source", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("mix_rank"))
    given = weights or target_weights(found)
    least = min(given.values())
    wanted = {s: given.get(s, least) for s in found}
    quota = exact_quotas(wanted)
    ranked = _ranked(rows, "source", range_rows, sum(found.values()))
    blocks = ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long"))
    if not all(quota.values()) or sum(quota.values()) > max(period, 10 * len(found)):
        return _run(blocks, quota, found, block)
    turns: dict = {}
    table = []
    for slot, source in enumerate(schedule(quota)):
        turns[source] = turns.get(source, -1) + 1
        table.append((source, turns[source], slot, quota[source]))
    length = len(table)
    # At most max(period, ten for each source) rows, as checked above.
    slots = F.broadcast(spark.createDataFrame(table, "slot_source string, turn long, slot_in long, quota long"))
    # quota depends on the source alone and turn on quota, so quotas are joined first.
    per_source = F.broadcast(spark.createDataFrame([(s, q) for s, q in quota.items()], "quota_source string, per_period long"))
    timed = (
        blocks.join(per_source, F.col("source").eqNullSafe(F.col("quota_source")))
        .withColumn("of_turn", F.col("block") % F.col("per_period"))
        .join(slots, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("of_turn") == F.col("turn")))
        .withColumn("slot", F.floor(F.col("block") / F.col("per_period")).cast("long") * length + F.col("slot_in"))
        .select("doc_id", "source", "block", "slot", "rank")
    )
    placed = _placed(cut(timed), block)
    return placed.select("doc_id", "source", "block", "slot", "mix_rank")


def _run(blocks: DataFrame, quota: dict, found: dict, block: int) -> DataFrame:
    """What mix() returns, by a schedule of the whole run: sizes of blocks are known, so their first places are too."""
    spark = blocks.sparkSession
    names, sources, numbers, slots = run_schedule(quota, {s: -(-n // block) for s, n in found.items()})
    source, number = np.array(sources, np.int64), np.array(numbers, np.int64)
    sizes = np.minimum(block, np.array([found[s] for s in names], np.int64)[source] - number * block)
    columns = {"of_k": source, "of_block": number, "slot": np.array(slots, np.int64), "start": np.cumsum(sizes) - sizes}
    table = spark.createDataFrame(pa.table(columns))
    # One row for each source; they are on the driver already.
    k_of = F.broadcast(spark.createDataFrame(list(enumerate(names)), "k long, k_source string"))
    numbered = blocks.join(k_of, F.col("source").eqNullSafe(F.col("k_source")))
    timed = numbered.join(table, (F.col("k") == F.col("of_k")) & (F.col("block") == F.col("of_block")))
    rank = F.col("start") + F.col("rank") - F.col("block") * block
    return timed.select("doc_id", "source", "block", "slot", rank.cast("long").alias("mix_rank"))


def _ranked(rows: DataFrame, group: str, range_rows: int, total: int) -> DataFrame:
    """Adds rank (from 0) within the group by (key, doc_id). A hot group is ranked range by range of its key."""
    ranges = max(1, math.ceil(total / range_rows))
    cell = rows.withColumn("range", F.floor((F.col("key") / 2.0**64 + 0.5) * ranges).cast("long"))
    inside = Window.partitionBy(group, "range").orderBy("key", "doc_id")
    local = cell.withColumn("at", F.row_number().over(inside) - 1)
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cell.groupBy(group, "range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col(group).alias("of_group"), F.col("range").alias("of_range"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    joined = local.join(starts, F.col(group).eqNullSafe(F.col("of_group")) & (F.col("range") == F.col("of_range")))
    return joined.withColumn("rank", F.col("at") + F.col("start")).drop("range", "at", "of_group", "of_range", "start")


def _placed(timed: DataFrame, block: int) -> DataFrame:
    """Adds mix_rank: places in order of (slot, rank). A slot has one block, so one task ranks few rows; the
    slots' sizes are summed by ranges of slots, then over the ranges."""
    inside = Window.partitionBy("slot").orderBy("rank")
    sizes = timed.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("stripe", F.floor(F.col("slot") / 4096))
    stripes = sizes.groupBy("stripe").agg(F.sum("n").alias("n"))
    # One row for each 4096 slots (65 536 documents) meets in one task.
    over = Window.orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    base = stripes.select(F.col("stripe"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    before = Window.partitionBy("stripe").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .join(base, "stripe")
        .select(F.col("slot").alias("of_slot"), (F.col("before") + F.col("base")).alias("start"))
    )
    return (
        timed.withColumn("at", F.row_number().over(inside) - 1)
        .join(starts, F.col("slot") == F.col("of_slot"))
        .withColumn("mix_rank", (F.col("start") + F.col("at")).cast("long"))
    )


def places(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """(mixed_id, mix_rank): one row for each id; rows that repeat an id share its first place."""
    return mix(docs, weights).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.min("mix_rank").alias("mix_rank"))


def ordered(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """All rows of docs with their columns, laid out in mixture order over the partitions. Readers of files
    need not keep it: the place itself is what places() gives, the same for the same rows."""
    ranks = places(docs, weights)
    joined = docs.join(ranks, id_of(docs["doc_id"]) == id_of(ranks["mixed_id"]))
    rank = ranks["mix_rank"]
    return joined.repartitionByRange(rank).sortWithinPartitions(rank).select(*[docs[c] for c in docs.columns])
