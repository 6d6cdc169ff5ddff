"""Connected components over edges between integer ids, by alternating star contractions.

No neighbour list is ever gathered: each step takes minima with a grouped aggregate (combined
before the shuffle) and reads them back with a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over edges (a, b) with a > b.

    Large star: every neighbour of u above u is linked to the least of u and its neighbours.
    Small star: u and its neighbours below u are linked to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # The neighbours above u are the rows in which u is the lower end.
        moved = edges.join(least, F.col("b") == F.col("u")).select(F.col("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        moved = (
            edges.join(least, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for each id in an edge (a, b); component is the least id reachable.

    Raises if the contraction has not settled after max_rounds, which is far above the
    logarithmic number it needs.
    """
    now = cut(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    digest = None
    for _ in range(max_rounds):
        # Settled when all edges lead straight to a root, which no further step changes.
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1_000_003)).first()
        if seen == digest or seen[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        digest = seen
        now = cut(_star(_star(now, True), False))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
