import json

import pytest

from tidemark.operators import actions, backup
from tidemark.operators.security import Issuer, Refused, SoftwareSigner, verifier
from tidemark.operators.store import Store
from tidemark.service import BUSY, NO_METHOD, PARSE_ERROR, REFUSED, Service, TokenBucket
from tidemark.sources import adapters as A


def test_story(spark, tmp_path):
    """Three observations, a claim from the untrusted one on a branch, a merge, an action, and its recall."""
    signer = SoftwareSigner(spark, "k")
    issuer = Issuer(signer, verifier(spark), "acme")
    store = Store(spark, str(tmp_path / "store"), issuer, clock=lambda: 1_700_000_000_000)

    class Suspend:
        action_type, is_simulated, compensating_action = "identity.suspend_account", False, "identity.reinstate_account"

        def execute(self, p):
            return actions.Outcome("success", "HELPDESK-1")

    gateway = actions.ActionGateway(lambda p: True, [Suspend()])
    service = Service(store, A.rules(spark), gateway=gateway)

    def call(method, **params):
        return json.loads(service.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))

    token = call("session.open", name="s1")["result"]["token"]
    who = {"actor": "agent", "branch": "s1", "intent": "work"}
    for key, system, record, trust in (("obs/erp", "erp", "invoice-88", 0), ("obs/S", "web", "scraped-page-S", 3)):
        got = call("observe", token=token, key=key, system=system, record_id=record, trust=trust, payload="p", text=f"risk of user-42 in {system}", **who)
        assert "commit" in got["result"], got
    token = call("branch.create", token=token, **{"from": "s1"}, name="h2")["result"]["token"]
    assert call("read", token=token, branch="h2", key="obs/S")["result"]["record"]["key"] == "obs/S"
    made = call("claim.assert", token=token, key="claim/risk", claim={"predicate": "risk", "subject": "user-42", "evidence": ["web:scraped-page-S"], "method": "LanguageModel", "confidence": 0.9}, text="user-42 is a risk", **{**who, "branch": "h2"})
    assert "commit" in made["result"]
    assert call("branch.merge", token=token, source="h2", **who)["result"]["result"] == "merged"
    found = call("retrieve", token=token, branch="s1", actor="agent", purpose="public_answer", query="risk user", budget=100)["result"]
    assert [i["key"] for i in found["items"]] == ["obs/erp"]  # what is untrusted is never packed
    proposed = {"token": token, "branch": "s1", "actor": "agent", "action_type": "identity.suspend_account", "target": "user-42", "idempotency_key": "susp-1", "evidence_keys": ["claim/risk"]}
    assert call("action.propose", **proposed)["result"] == {"proposed": "susp-1"}

    gateway.execute(actions.Proposal("identity.suspend_account", "user-42", "susp-1", "operator", evidence=((True, "Asserted"),), evidence_keys=("claim/risk",)))
    # The ledger is the gateway's: what a caller leaves out is in the plan all the same.
    audit = call("audit.taint", token=token, branch="s1", source="web:scraped-page-S", executed=[])["result"]
    plan = audit["plan"]
    assert plan.index("suspend_account on user-42") < plan.index("claim/risk") and "obs/erp" not in plan and "receipt HELPDESK-1" in plan
    assert (audit["irreversible"], audit["reversible"]) == (1, 4)  # two records, on s1 and h2
    rows = spark.read.parquet(audit["table"]).collect()
    assert {(r.branch, r.key) for r in rows if r.section == "reversible"} == {(b, k) for b in ("s1", "h2") for k in ("obs/S", "claim/risk")}
    assert all(r.commit and r.derived_via for r in rows if r.section == "reversible")
    (done,) = [r for r in rows if r.section == "irreversible"]
    assert (done.receipt, done.compensating_action) == ("HELPDESK-1", "identity.reinstate_account") and done.derived_via

    assert call("execute")["error"]["code"] == NO_METHOD
    assert call("read", token=token, branch="main", key="x")["error"]["code"] == REFUSED
    assert json.loads(service.handle("{"))["error"]["code"] == PARSE_ERROR
    assert len(call("tools.list")["result"]) == 10
    service.bucket = TokenBucket(0, 0)
    assert call("tools.list")["error"]["code"] == BUSY
    assert service.telemetry.failures == 4 and service.telemetry.denied == 1

    # A backup of the store, tampered with and restored.
    check = verifier(spark)
    head = backup.create(spark, store.root, str(tmp_path / "b1"), "acme", signer)
    assert head["files"] > 10 and backup.verify(spark, str(tmp_path / "b1"), "acme", check, signer.public_key).isEmpty()
    backup.restore(spark, str(tmp_path / "b1"), str(tmp_path / "again"), "acme", check, signer.public_key)
    assert Store(spark, str(tmp_path / "again"), issuer).branches() == store.branches()
    with pytest.raises(FileExistsError):
        backup.restore(spark, str(tmp_path / "b1"), str(tmp_path / "again"), "acme", check, signer.public_key)
    with pytest.raises(Refused):
        backup.verify(spark, str(tmp_path / "b1"), "other", check, signer.public_key)
    (tmp_path / "b1/data/extra.txt").write_text("x")
    assert [tuple(r) for r in backup.verify(spark, str(tmp_path / "b1"), "acme", check, signer.public_key).collect()] == [("extra.txt", "extra")]
    with pytest.raises(Refused):
        backup.restore(spark, str(tmp_path / "b1"), str(tmp_path / "third"), "acme", check, signer.public_key)


def test_small_helpers():
    assert backup.receipt("drill", 0, 5, {"a": True, "b": True})["passed"] and not backup.receipt("drill", 0, 5, {})["passed"]
    assert backup.human_bytes(1536) == "1.5 KB" and backup.human_duration(61_500) == "1 min 1 s"
    assert backup.metrics_text({"b": 2, "a": 1.5}) == "tidemark_a 1.5\ntidemark_b 2\n"
