"""Record-level three-way merge: one shuffle brings the sides of a key together, one CASE decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

SIDES = ("base", "source", "target")
FIELDS = ["kind", "counter", "members", "body", "object", "valid_start", "valid_end", "method_rank", "confidence"]


def aligned(states: DataFrame) -> DataFrame:
    """(key, base, source, target): the record of each side as a struct, null where the side has none."""
    record = F.struct(*FIELDS)
    return states.groupBy("key").agg(*[F.max(F.when(F.col("side") == s, record)).alias(s) for s in SIDES])


def _claim_winner() -> Column:
    """"source", "target", or null for a conflict, between two claims."""
    s, t = F.col("source"), F.col("target")
    meet = X.overlaps(s["valid_start"], s["valid_end"], t["valid_start"], t["valid_end"])
    unknown = s["valid_start"].isNull() | t["valid_start"].isNull()
    later = F.when(unknown, F.lit(None)).when(s["valid_start"] >= t["valid_start"], F.lit("source")).otherwise(F.lit("target"))
    a, b = X.tiebreak(s["method_rank"], s["confidence"]), X.tiebreak(t["method_rank"], t["confidence"])
    return F.when(~meet, later).when(a > b, F.lit("source")).when(a < b, F.lit("target"))


def decided(states: DataFrame, policy: str = "conflict") -> DataFrame:
    """Per key the outcome of the merge: none, counter, set, claim_source, claim_target, take_source, policy_source,
    policy_target or conflict, and the merged record where one is written.

    A delete on the source of a key that the target left alone is not carried over; a delete
    against an edit is a conflict. policy: what settles a conflict (conflict, source, target).
    """
    rows = aligned(states)
    b, s, t = (F.col(x) for x in SIDES)
    same_kind = s["kind"] == t["kind"]
    winner = _claim_winner()
    conflict = {"conflict": F.lit("conflict"), "source": F.lit("policy_source"), "target": F.lit("policy_target")}[policy]
    outcome = (
        F.when(s.eqNullSafe(t), F.lit("none"))
        .when(s.eqNullSafe(b), F.lit("none"))
        .when(t.eqNullSafe(b), F.when(s.isNull(), F.lit("none")).otherwise(F.lit("take_source")))
        .when(s.isNull() | t.isNull(), conflict)
        .when(same_kind & (s["kind"] == "counter"), F.lit("counter"))
        .when(same_kind & (s["kind"] == "set"), F.lit("set"))
        .when(same_kind & (s["kind"] == "claim") & (winner == "source"), F.lit("claim_source"))
        .when(same_kind & (s["kind"] == "claim") & (winner == "target"), F.lit("claim_target"))
        .otherwise(conflict)
    )
    merged = (
        F.when(F.col("outcome") == "counter", s.withField("counter", X.merge_counters(b["counter"], s["counter"], t["counter"])))
        .when(F.col("outcome") == "set", s.withField("members", X.merge_sets(s["members"], t["members"])))
        .when(F.col("outcome").isin("take_source", "claim_source", "policy_source"), s)
        .when(F.col("outcome").isin("claim_target", "policy_target"), t)
    )
    return rows.withColumn("outcome", outcome).withColumn("merged", merged)


def conflict_reason() -> Column:
    s, t = F.col("source"), F.col("target")
    return (
        F.when(s.isNull(), F.lit("deleted in source, edited in target"))
        .when(t.isNull(), F.lit("edited in source, deleted in target"))
        .when(s["kind"] != t["kind"], F.lit("different kinds"))
        .when(s["kind"] == "claim", F.lit("claims of equal standing disagree"))
        .otherwise(F.format_string("both sides changed a %s", s["kind"]))
    )


def conflicts(plan: DataFrame) -> DataFrame:
    """The conflicts of a plan; a merge writes nothing while there is one."""
    return plan.where(F.col("outcome") == "conflict").select("key", conflict_reason().alias("reason"))


def writes(plan: DataFrame) -> DataFrame:
    """What the merge would write to the target: keys whose record changes."""
    return plan.where(F.col("merged").isNotNull() & ~F.col("merged").eqNullSafe(F.col("target"))).select("key", "outcome", "merged")


def resolve(plan: DataFrame, resolver) -> DataFrame:
    """Settles conflicts by a resolver over batches: it gets a pandas frame of key, source and target (as JSON) and
    returns a series of "source", "target" or "conflict", one for each row."""

    @F.pandas_udf("string")
    def choice(key: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
        return resolver(pd.DataFrame({"key": key, "source": source, "target": target}))

    asked = plan.withColumn("choice", F.when(F.col("outcome") == "conflict", choice("key", F.to_json("source"), F.to_json("target"))))
    picked = F.when(F.col("choice") == "source", F.lit("policy_source")).when(F.col("choice") == "target", F.lit("policy_target")).otherwise(F.col("outcome"))
    merged = F.when(F.col("choice") == "source", F.col("source")).when(F.col("choice") == "target", F.col("target")).otherwise(F.col("merged"))
    return asked.withColumn("outcome", picked).withColumn("merged", merged).drop("choice")
