"""Ten verbs for agents over line-delimited JSON-RPC, behind size and rate limits. None of them acts on the world."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import actions, recall, retrieval
from tidemark.operators.checkpoints import Table
from tidemark.operators.security import Envelope, Refused, Token
from tidemark.operators.store import Store
from tidemark.sources import formats

#: Error codes of the JSON-RPC protocol.
PARSE_ERROR, INVALID_REQUEST, NO_METHOD, INVALID_PARAMS, INTERNAL, REFUSED, BUSY = -32700, -32600, -32601, -32602, -32603, -32001, -32002
MAX_LINE = 1 << 20


class TokenBucket:
    def __init__(self, rate: float, burst: float, clock: Callable[[], float] = time.monotonic) -> None:
        self.rate, self.burst, self.clock = rate, burst, clock
        self.level, self.at = burst, clock()

    def admit(self) -> bool:
        now = self.clock()
        self.level, self.at = min(self.burst, self.level + (now - self.at) * self.rate), now
        if self.level < 1:
            return False
        self.level -= 1
        return True


class RequestObserver(Protocol):
    """What a service tells of each request: the seconds it took, and whether it failed or was refused."""

    def seen(self, took: float, failed: bool, denied: bool) -> None: ...


class Telemetry:
    """Counts requests."""

    def __init__(self) -> None:
        self.requests = self.failures = self.denied = 0
        self.seconds = 0.0

    def seen(self, took: float, failed: bool, denied: bool) -> None:
        self.requests, self.failures, self.denied, self.seconds = self.requests + 1, self.failures + failed, self.denied + denied, self.seconds + took


class Service:
    def __init__(self, store: Store, rules, bucket: TokenBucket | None = None, gateway: actions.ActionGateway | None = None, observer: RequestObserver | None = None) -> None:
        """gateway: the operator's, whose ledger audits read; no verb can reach its execute()."""
        self.store, self.rules, self.bucket, self.gateway = store, rules, bucket or TokenBucket(50, 100), gateway
        self.agent, self.telemetry = actions.AgentStore(), observer or Telemetry()
        self.verbs = {
            "session.open": self.session_open,
            "observe": self.observe,
            "branch.create": self.branch_create,
            "claim.assert": self.claim_assert,
            "read": self.read,
            "retrieve": self.retrieve,
            "branch.merge": self.branch_merge,
            "branch.rewind": self.branch_rewind,
            "action.propose": self.action_propose,
            "audit.taint": self.audit_taint,
        }

    # -- verbs --

    def _envelope(self, p: dict, token: Token) -> Envelope:
        return Envelope(p["actor"], token.session, p["branch"], p["intent"], tuple(p.get("derived_from", ())), tuple(p.get("sources", ())), p.get("signature", ""))

    def _hint(self, p: dict):
        text = p.get("text")
        return None if text is None else self.store.spark.createDataFrame([(p["key"], text, p.get("embedding"))], "key string, text string, embedding array<float>")

    def session_open(self, p: dict) -> dict:
        return {"token": self.store.open_session(p.get("name")).to_json()}

    def observe(self, p: dict) -> dict:
        t = Token.from_json(p["token"])
        row = self.store.spark.createDataFrame([(p["key"], f"{p['system']}:{p['record_id']}", p.get("payload", ""), int(p["trust"]))], "k string, s string, p string, t int")
        rows = formats.observations(row, F.col("k"), F.col("s"), F.col("p"), F.col("t"), F.lit(self.store.clock()))
        return {"commit": self.store.write(t, p["branch"], self._envelope(p, t), rows, hints=self._hint(p))}

    def branch_create(self, p: dict) -> dict:
        return {"token": self.store.branch(Token.from_json(p["token"]), p["from"], p["name"]).to_json()}

    def claim_assert(self, p: dict) -> dict:
        t = Token.from_json(p["token"])
        columns = {k: F.lit(v) for k, v in p["claim"].items() if k != "evidence"}
        evidence = F.array(*[F.lit(x) for x in p["claim"].get("evidence", [])]).cast("array<string>")
        rows = formats.claims(self.store.spark.range(1), F.lit(p["key"]), evidence=evidence, actor=F.lit(p["actor"]), **{"status": F.lit("Asserted"), "known_start": F.lit(self.store.clock()), **columns})
        return {"commit": self.store.write(t, p["branch"], self._envelope(p, t), rows, hints=self._hint(p))}

    def read(self, p: dict) -> dict:
        row = self.store.read(Token.from_json(p["token"]), p["branch"], p["key"]).toJSON().first()
        return {"record": json.loads(row) if row else None}

    def retrieve(self, p: dict) -> dict:
        t = Token.from_json(p["token"])
        self.store.issuer.check(t, self.store.clock(), p["branch"])
        entries = retrieval.may_pack(self.store.index(p["branch"]), self.rules, p["actor"], p["purpose"])
        packed = retrieval.pack(retrieval.scored(entries, p["query"], p.get("embedding")), int(p["budget"]))
        items = packed.where("packed").orderBy("pack_rank").select("key", "text", "citations", "stale", "score").collect()
        return {"items": [r.asDict() for r in items], **retrieval.totals(packed).first().asDict()}

    def branch_merge(self, p: dict) -> dict:
        t = Token.from_json(p["token"])
        got = self.store.merge(t, p["source"], p["branch"], self._envelope(p, t), policy=p.get("policy", "conflict"))
        return {"result": got.kind, "commit": got.commit, "automatic": got.automatic}

    def branch_rewind(self, p: dict) -> dict:
        return {"previous": self.store.rewind(Token.from_json(p["token"]), p["branch"], p["commit"])}

    def action_propose(self, p: dict) -> dict:
        t = Token.from_json(p["token"])
        self.store.issuer.check(t, self.store.clock(), p["branch"])
        made = self.agent.propose(actions.Proposal(p["action_type"], p["target"], p["idempotency_key"], p["actor"], p["branch"], p.get("tenant", ""), bool(p.get("simulation")), evidence_keys=tuple(p.get("evidence_keys", ()))))
        return {"proposed": made.idempotency_key}

    def audit_taint(self, p: dict) -> dict:
        """The recall plan of a source over every branch of the tenant, with the actions of the gateway's own ledger:
        what a caller says was executed is not asked. The whole plan is a table; the text shows how much of it."""
        t = Token.from_json(p["token"])
        self.store.issuer.check(t, self.store.clock(), p["branch"])
        done = [r for r in (self.gateway.records() if self.gateway else []) if r["status"] == "Succeeded"]
        rows = [(k, r["type"], r["target"], r["idempotency_key"], r["compensating_action"], r["receipt"]) for r in done for k in r["justified_by"]]
        executed = self.store.spark.createDataFrame(rows, "evidence_key string, action_type string, target string, idempotency_key string, compensating_action string, receipt string")
        plan = Table(self.store.recall_plan(p["source"], executed.withColumn("action_id", X.action_id(F.col("idempotency_key")))), "recall")
        return {"plan": recall.render(plan.last), "table": plan.paths[0], **recall.totals(plan.last)}

    # -- protocol --

    def handle(self, line: str) -> str:
        began, answer, denied = time.monotonic(), {"jsonrpc": "2.0", "id": None}, False

        def fail(code: int, message: str) -> None:
            answer["error"] = {"code": code, "message": message}

        try:
            if len(line) > MAX_LINE:
                fail(INVALID_REQUEST, "the line is too long")
            elif not self.bucket.admit():
                fail(BUSY, "too many requests")
            else:
                request = json.loads(line)
                answer["id"] = request.get("id") if isinstance(request, dict) else None
                if not isinstance(request, dict) or "method" not in request:
                    fail(INVALID_REQUEST, "not a request")
                elif request["method"] == "tools.list":
                    answer["result"] = sorted(self.verbs)
                elif request["method"] not in self.verbs:
                    fail(NO_METHOD, "no such method")
                else:
                    answer["result"] = self.verbs[request["method"]](request.get("params") or {})
        except json.JSONDecodeError:
            fail(PARSE_ERROR, "not JSON")
        except Refused:
            denied = True
            fail(REFUSED, "refused")
        except (KeyError, TypeError, ValueError) as e:
            fail(INVALID_PARAMS, f"bad parameters: {type(e).__name__}")
        except Exception:
            fail(INTERNAL, "internal error")
        self.telemetry.seen(time.monotonic() - began, "error" in answer, denied)
        return json.dumps(answer, default=str)

    def serve(self, lines: Iterable[str]) -> Iterable[str]:
        for line in lines:
            if line.strip():
                yield self.handle(line)
