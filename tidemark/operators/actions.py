"""The action ledger: idempotent decisions in bulk, and an operator-only gateway that calls connectors."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import policy


def first_proposals(proposals: DataFrame) -> DataFrame:
    """Of the proposals of one idempotency key the first to arrive; the others get its outcome."""
    w = Window.partitionBy("idempotency_key").orderBy("arrived", "event_id")
    return proposals.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def outcome_status(code: Column) -> Column:
    """0 success with a receipt, 1 success without one, 2 failure, 3 unknown, 4 time-out."""
    return F.when(code == 0, F.lit("Succeeded")).when(code == 2, F.lit("Failed")).otherwise(F.lit("Indeterminate"))


def decide(proposals: DataFrame, rules: DataFrame, disabled: list[str], connectors: DataFrame) -> DataFrame:
    """First proposals with their status: kill switch, evidence, policy, connector, then the connector's outcome.

    connectors: (action_type, simulated). A simulation never runs on a real connector.
    """
    requests = first_proposals(proposals).select("*", F.lit("agent").alias("actor"), F.lit("authorize_action").alias("purpose"), F.col("action_type").alias("action"))
    judged = policy.decide(requests, rules).join(connectors.select("action_type", "simulated"), "action_type", "left")
    status = (
        F.when(F.col("tenant").isin(*disabled) if disabled else F.lit(False), F.lit("Refused: disabled"))
        .when(~F.col("has_evidence"), F.lit("Refused: no evidence"))
        .when(F.col("decision") == "Deny", F.lit("Refused: policy"))
        .when(F.col("simulated").isNull(), F.lit("Refused: no connector"))
        .when(F.col("simulation") & ~F.col("simulated"), F.lit("Refused: simulation"))
        .otherwise(outcome_status(F.col("outcome")))
    )
    return judged.select("event_id", X.action_id(F.col("idempotency_key")).alias("action_id"), "idempotency_key", "action_type", "target", "evidence_key", "compensating_action", status.alias("status"))


def executed(decisions: DataFrame) -> DataFrame:
    """Only what succeeded for certain counts as executed."""
    return decisions.where(F.col("status") == "Succeeded")


# ---- the gateway: driver-side, one call at a time for each key ------------------------------------


@dataclass(frozen=True)
class Proposal:
    action_type: str
    target: str
    idempotency_key: str
    actor: str
    branch: str = "main"
    tenant: str = ""
    simulation: bool = False
    evidence: tuple = ()  # (has evidence, status) of each claim
    evidence_keys: tuple[str, ...] = ()
    label: int = 0


@dataclass(frozen=True)
class Outcome:
    kind: str  # "success", "failed", "indeterminate"
    receipt: str | None = None


class Connector(Protocol):
    action_type: str
    is_simulated: bool
    compensating_action: str | None

    def execute(self, proposal: Proposal) -> Outcome: ...


class AgentStore:
    """What an agent holds: it can propose, and has no method that acts."""

    def __init__(self) -> None:
        self.proposed: list[Proposal] = []

    def propose(self, proposal: Proposal) -> Proposal:
        self.proposed.append(proposal)
        return proposal


@dataclass
class KillSwitch:
    everything: bool = False
    tenants: set[str] = field(default_factory=set)

    def disable_all(self) -> None:
        self.everything = True

    def enable_all(self) -> None:
        """Lifts the general stop; tenants that were stopped one by one stay so."""
        self.everything = False

    def disable_tenant(self, tenant: str) -> None:
        self.tenants.add(tenant)

    def is_disabled(self, tenant: str) -> bool:
        return self.everything or tenant in self.tenants


class ActionGateway:
    """Runs proposals for an operator. The first decision on a key is final, a refusal too."""

    def __init__(self, allows: Callable[[Proposal], bool], connectors: list[Connector], switch: KillSwitch | None = None) -> None:
        self._allows, self._connectors = allows, {c.action_type: c for c in connectors}
        self.switch, self._records, self._lock = switch or KillSwitch(), {}, threading.Lock()

    def execute(self, proposal: Proposal) -> dict:
        with self._lock:
            if proposal.idempotency_key not in self._records:
                self._records[proposal.idempotency_key] = self._decide(proposal)
            return self._records[proposal.idempotency_key]

    def _decide(self, p: Proposal) -> dict:
        record = {"idempotency_key": p.idempotency_key, "type": p.action_type, "target": p.target, "actor": p.actor, "branch": p.branch, "justified_by": p.evidence_keys, "receipt": None, "compensating_action": None}
        refused = lambda why: record | {"status": f"Refused: {why}"}
        if self.switch.is_disabled(p.tenant):
            return refused("disabled")
        if not p.evidence or any(not has or status != "Asserted" for has, status in p.evidence):
            return refused("no evidence")
        if not self._allows(p):
            return refused("policy")
        connector = self._connectors.get(p.action_type)
        if connector is None:
            return refused("no connector")
        if p.simulation and not connector.is_simulated:
            return refused("simulation")
        record["compensating_action"] = connector.compensating_action
        try:
            got = connector.execute(p)
        except Exception:  # what a connector did before it broke is unknown
            return record | {"status": "Indeterminate"}
        if got.kind == "failed":
            return record | {"status": "Failed"}
        if got.kind != "success" or not got.receipt:
            return record | {"status": "Indeterminate"}
        return record | {"status": "Succeeded", "receipt": got.receipt}

    def records(self) -> list[dict]:
        return list(self._records.values())
