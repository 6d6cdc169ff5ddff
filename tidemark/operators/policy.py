"""Deny-overrides, fail-closed policy decisions in bulk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("actor", "label", "purpose", "action")
#: Rules beyond this many are refused: they are joined to every request.
MAX_RULES = 10_000


def checked(rules: DataFrame) -> DataFrame:
    """The rules, broadcast: their number is checked first."""
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return F.broadcast(rules)


def _applies(exact_action: bool) -> Column:
    wild: Column = F.lit(True)
    for f in FIELDS:
        if f != "action":
            wild = wild & (F.col(f"r_{f}").isNull() | (F.col(f"r_{f}") == F.col(f)))
    return wild & (F.col("r_action") == F.col("action") if exact_action else F.col("r_action").isNull())


def decide(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds decision and rationale: any denying rule denies, else any allowing rule allows, else it is denied.

    Decisions are made once for each distinct request. Rules for one action meet their requests
    by an equality join, rules for any action by their other fields.
    """
    few = checked(rules)
    distinct = requests.select(*FIELDS).distinct()
    exact = distinct.join(few.where(F.col("r_action").isNotNull()), _applies(True), "left").select(*FIELDS, "effect")
    wild = distinct.join(few.where(F.col("r_action").isNull()), _applies(False), "left").select(*FIELDS, "effect")
    verdicts = exact.unionByName(wild).groupBy(*FIELDS).agg(
        F.coalesce(F.bool_or(F.col("effect") == "Deny"), F.lit(False)).alias("denied"), F.coalesce(F.bool_or(F.col("effect") == "Allow"), F.lit(False)).alias("allowed")
    )
    decision = F.when(F.col("denied"), F.lit("Deny")).when(F.col("allowed"), F.lit("Allow")).otherwise(F.lit("Deny"))
    rationale = F.when(F.col("denied"), F.lit("a rule denies")).when(F.col("allowed"), F.lit("a rule allows")).otherwise(F.lit("no rule applies"))
    named = verdicts.select(*[F.col(f).alias(f"v_{f}") for f in FIELDS], decision.alias("decision"), rationale.alias("rationale"))
    same = F.lit(True)
    for f in FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"v_{f}"))
    return requests.join(named, same).drop(*[f"v_{f}" for f in FIELDS])


def verdict(document: dict | None, request: dict) -> dict:
    """One decision by a policy document, with its version, the request and why: what an audit keeps."""
    effects = {e for *match, e in validate(document) if all(m is None or m == request.get(f) for m, f in zip(match, FIELDS))}
    allowed = effects == {"Allow"}
    why = "a rule denies" if "Deny" in effects else "a rule allows" if allowed else "no rule applies"
    return {"decision": "Allow" if allowed else "Deny", "rationale": why, "version": str((document or {}).get("version", "")), "request": {f: request.get(f) for f in FIELDS}}


def validate(document: dict | None) -> list[tuple]:
    """Rules of a policy document {version, rules}, as rows for the rules table. No document allows nothing."""
    if document is None:
        return []
    if not 1 <= len(str(document.get("version", ""))) <= 128:
        raise ValueError("the version must have 1 to 128 characters")
    rows = document.get("rules", [])
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = []
    for r in rows:
        for f in ("actor", "purpose", "action"):
            if r.get(f) is not None and not 1 <= len(r[f].encode()) <= 256:
                raise ValueError(f"{f} must have 1 to 256 bytes")
        if r.get("effect") not in ("Allow", "Deny") or r.get("label") not in (None, 0, 1, 2, 3):
            raise ValueError("a rule needs an effect of Allow or Deny, and a known label")
        out.append((r.get("actor"), r.get("label"), r.get("purpose"), r.get("action"), r["effect"]))
    return out
