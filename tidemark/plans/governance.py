"""Queries over policy decisions, the action ledger, manifests and backups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import actions, custody, policy
from tidemark.sources import adapters as A

DISABLED = ["t3"]
#: Action types with a connector, and whether it only simulates.
CONNECTORS = [("identity.suspend_account", False), ("billing.refund", True), ("mail.send", True)]


def _connectors(spark):
    return spark.createDataFrame(CONNECTORS, "action_type string, simulated boolean")


def _decided(spark, sf_dir):
    return actions.decide(A.actions(spark, sf_dir), A.rules(spark), DISABLED, _connectors(spark))


def executed_actions_frame(spark, sf_dir):
    return actions.executed(_decided(spark, sf_dir))


def policy_decide(spark, sf_dir):
    """Every combination of a few actors, labels, purposes and actions, decided."""
    d = spark.range(1).select(
        F.explode(F.array(*[F.lit(x) for x in ("agent", "guest")])).alias("actor")
    ).select("actor", F.explode(F.array(*[F.lit(x) for x in range(4)])).alias("label"))
    d = d.select("*", F.explode(F.array(F.lit("authorize_action"), F.lit("public_answer"))).alias("purpose"))
    d = d.select("*", F.explode(F.array(*[F.lit(x) for x in ("identity.suspend_account", "billing.refund", "mail.send", "crm.tag", "pack_into_context")])).alias("action"))
    return policy.decide(d, A.rules(spark))


def _requests(spark, sf_dir):
    a = A.actions(spark, sf_dir)
    actor = F.when(F.col("event_id") % 3 == 0, F.lit("guest")).otherwise(F.lit("agent"))
    return a.select("event_id", actor.alias("actor"), "label", F.lit("authorize_action").alias("purpose"), F.col("action_type").alias("action"))


def policy_decide_bulk(spark, sf_dir):
    return policy.decide(_requests(spark, sf_dir), A.rules(spark)).select("event_id", "decision", "rationale")


def policy_part_rules(spark, sf_dir):
    """A larger rule set from parts (size as label, brand as actor) against the actions of suppliers."""
    p = A.table(spark, sf_dir, "part").groupBy("p_brand", (F.col("p_size") % 4).cast("int").alias("l")).agg(F.min("p_partkey").alias("k"))
    rules = p.select(F.col("p_brand").alias("r_actor"), F.when(F.col("k") % 3 != 0, F.col("l")).alias("r_label"), F.lit(None).cast("string").alias("r_purpose"), F.when(F.col("k") % 2 == 0, F.lit("crm.tag")).alias("r_action"), F.when(F.col("k") % 5 == 0, F.lit("Deny")).otherwise(F.lit("Allow")).alias("effect"))
    asked = A.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("actor"), (F.col("p_size") % 4).cast("int").alias("label"), F.lit("authorize_action").alias("purpose"), F.when(F.col("p_partkey") % 2 == 0, F.lit("crm.tag")).otherwise(F.lit("mail.send")).alias("action"))
    return policy.decide(asked, rules).select("p_partkey", "decision")


def may_pack(spark, sf_dir):
    labels = A.index_entries(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    asked = labels.select("label", "n", F.lit("agent").alias("actor"), F.lit("public_answer").alias("purpose"), F.lit("pack_into_context").alias("action"))
    return policy.decide(asked, A.rules(spark)).select("label", "n", "decision")


def may_authorize(spark, sf_dir):
    return policy.decide(_requests(spark, sf_dir), A.rules(spark)).groupBy("label", "action").agg(F.count(F.when(F.col("decision") == "Allow", 1)).alias("allowed"), F.count(F.when(F.col("decision") == "Deny", 1)).alias("denied"))


def action_dedup(spark, sf_dir):
    return actions.first_proposals(A.actions(spark, sf_dir)).select("idempotency_key", "event_id", "arrived")


def action_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("event_id", "action_id", "status")


def action_status_map(spark, sf_dir):
    a = A.actions(spark, sf_dir)
    return a.groupBy(actions.outcome_status(F.col("outcome")).alias("status"), "simulation").agg(F.count(F.lit(1)).alias("n"))


def executed_actions(spark, sf_dir):
    return executed_actions_frame(spark, sf_dir).select("event_id", "action_id", "action_type", "target")


def kill_switch_filter(spark, sf_dir):
    a = A.actions(spark, sf_dir)
    return a.groupBy("tenant", F.col("tenant").isin(*DISABLED).alias("disabled")).agg(F.count(F.lit(1)).alias("n"))


def evidence_check(spark, sf_dir):
    """Whether all claims that an action rests on (those of its target's subject) are eligible."""
    claims = A.claims(spark, sf_dir).select(F.concat(F.lit("c/"), F.col("subject")).alias("evidence_key"), X.eligible(F.col("evidence"), F.col("status")).alias("ok"), "predicate").where(F.col("predicate") == "signup")
    verdict = claims.groupBy("evidence_key").agg(F.bool_and("ok").alias("all_ok"))
    return A.actions(spark, sf_dir).join(verdict, "evidence_key", "left").select("event_id", F.coalesce("all_ok", F.lit(False)).alias("justified"))


def escalation_text(spark, sf_dir):
    a = A.actions(spark, sf_dir)
    return a.select("event_id", X.escalation(F.col("action_type"), F.col("target"), F.col("compensating_action")).alias("escalation"))


def manifest_verify(spark, sf_dir):
    return custody.verify_manifest(*A.manifests(spark, sf_dir))


def known_answer_compare(spark, sf_dir):
    expected, actual = A.manifests(spark, sf_dir)
    got = custody.known_answers(expected.select("path", "digest"), actual.select("path", F.col("digest").alias("actual_digest")))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("same"), 1)).alias("same"), F.bool_and("same").alias("passed"))


RECENT = 946_684_800_000  # 2000-01-01


def retention_plan(spark, sf_dir):
    return custody.retention(A.backups(spark, sf_dir), 2, RECENT).select("root", "backup", "newest", "decision")


def newest_backup(spark, sf_dir):
    return custody.newest(A.backups(spark, sf_dir)).select("root", "backup", "created")


QUERIES = {f.__name__: f for f in (policy_decide, policy_decide_bulk, policy_part_rules, may_pack, may_authorize, action_dedup, action_decisions, action_status_map, executed_actions, kill_switch_filter, evidence_check, escalation_text, manifest_verify, known_answer_compare, retention_plan, newest_backup)}

_MATCH = "(r_actor IS NULL OR r_actor = {0}.actor) AND (r_label IS NULL OR r_label = {0}.label) AND (r_purpose IS NULL OR r_purpose = {0}.purpose) AND (r_action IS NULL OR r_action = {0}.action)"
_DECISION = "CASE WHEN coalesce(bool_or(effect = 'Deny'), false) THEN 'Deny' WHEN coalesce(bool_or(effect = 'Allow'), false) THEN 'Allow' ELSE 'Deny' END AS decision"
_RATIONALE = "CASE WHEN coalesce(bool_or(effect = 'Deny'), false) THEN 'a rule denies' WHEN coalesce(bool_or(effect = 'Allow'), false) THEN 'a rule allows' ELSE 'no rule applies' END AS rationale"
_STATUS = "CASE outcome WHEN 0 THEN 'Succeeded' WHEN 2 THEN 'Failed' ELSE 'Indeterminate' END"
_ESCALATION = "split_part(action_type, '.', -1) || ' on ' || target || ' can''t be undone; ' || CASE WHEN compensating_action IS NOT NULL THEN 'compensate with ' || compensating_action ELSE 'a human must decide' END"

DECIDED_SQL = f"""{A.ACTIONS_SQL}, {A.RULES_SQL},
firsts AS (SELECT *, 'agent' AS actor, 'authorize_action' AS purpose, action_type AS action FROM actions QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY arrived, event_id) = 1),
verdicts AS (SELECT f.event_id, {_DECISION} FROM firsts f LEFT JOIN rules ON {_MATCH.format('f')} GROUP BY f.event_id),
connectors AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {str(b).lower()})" for a, b in CONNECTORS)}) AS t(c_type, simulated)),
decided AS (
  SELECT f.*, 'act-' || left(sha256(idempotency_key), 16) AS action_id,
         CASE WHEN tenant IN ('t3') THEN 'Refused: disabled' WHEN NOT has_evidence THEN 'Refused: no evidence' WHEN decision = 'Deny' THEN 'Refused: policy'
              WHEN simulated IS NULL THEN 'Refused: no connector' WHEN simulation AND NOT simulated THEN 'Refused: simulation' ELSE {_STATUS} END AS status
  FROM firsts f JOIN verdicts USING (event_id) LEFT JOIN connectors ON c_type = action_type)"""

_REQUESTS_SQL = f"""{A.ACTIONS_SQL}, {A.RULES_SQL},
requests AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'guest' ELSE 'agent' END AS actor, label, 'authorize_action' AS purpose, action_type AS action FROM actions),
judged AS (SELECT q.event_id, any_value(q.label) AS label, any_value(q.action) AS action, {_DECISION}, {_RATIONALE} FROM requests q LEFT JOIN rules ON {_MATCH.format('q')} GROUP BY q.event_id)"""

SQL = {
    "policy_decide": f"""WITH {A.RULES_SQL}, q AS (SELECT * FROM (SELECT unnest(['agent', 'guest']) AS actor), (SELECT CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS label),
      (SELECT unnest(['authorize_action', 'public_answer']) AS purpose), (SELECT unnest(['identity.suspend_account', 'billing.refund', 'mail.send', 'crm.tag', 'pack_into_context']) AS action))
      SELECT q.actor, q.label, q.purpose, q.action, {_DECISION}, {_RATIONALE} FROM q LEFT JOIN rules ON {_MATCH.format('q')} GROUP BY ALL""",
    "policy_decide_bulk": f"WITH {_REQUESTS_SQL} SELECT event_id, decision, rationale FROM judged",
    "policy_part_rules": f"""WITH p AS (SELECT p_brand, CAST(p_size % 4 AS INTEGER) AS l, min(p_partkey) AS k FROM part GROUP BY ALL),
      rules AS (SELECT p_brand AS r_actor, CASE WHEN k % 3 <> 0 THEN l END AS r_label, CAST(NULL AS VARCHAR) AS r_purpose, CASE WHEN k % 2 = 0 THEN 'crm.tag' END AS r_action, CASE WHEN k % 5 = 0 THEN 'Deny' ELSE 'Allow' END AS effect FROM p),
      q AS (SELECT p_partkey, p_brand AS actor, CAST(p_size % 4 AS INTEGER) AS label, 'authorize_action' AS purpose, CASE WHEN p_partkey % 2 = 0 THEN 'crm.tag' ELSE 'mail.send' END AS action FROM part)
      SELECT q.p_partkey, {_DECISION} FROM q LEFT JOIN rules ON {_MATCH.format('q')} GROUP BY q.p_partkey""",
    "may_pack": f"""WITH {A.INDEX_SQL}, {A.RULES_SQL}, q AS (SELECT label, count(*) AS n, 'agent' AS actor, 'public_answer' AS purpose, 'pack_into_context' AS action FROM index_entries GROUP BY label)
      SELECT q.label, q.n, {_DECISION} FROM q LEFT JOIN rules ON {_MATCH.format('q')} GROUP BY q.label, q.n""",
    "may_authorize": f"WITH {_REQUESTS_SQL} SELECT label, action, count(*) FILTER (decision = 'Allow') AS allowed, count(*) FILTER (decision = 'Deny') AS denied FROM judged GROUP BY label, action",
    "action_dedup": f"WITH {A.ACTIONS_SQL} SELECT idempotency_key, event_id, arrived FROM actions QUALIFY row_number() OVER (PARTITION BY idempotency_key ORDER BY arrived, event_id) = 1",
    "action_decisions": f"WITH {DECIDED_SQL} SELECT event_id, action_id, status FROM decided",
    "action_status_map": f"WITH {A.ACTIONS_SQL} SELECT {_STATUS} AS status, simulation, count(*) AS n FROM actions GROUP BY ALL",
    "executed_actions": f"WITH {DECIDED_SQL} SELECT event_id, action_id, action_type, target FROM decided WHERE status = 'Succeeded'",
    "kill_switch_filter": f"WITH {A.ACTIONS_SQL} SELECT tenant, tenant IN ('t3') AS disabled, count(*) AS n FROM actions GROUP BY ALL",
    "evidence_check": f"""WITH {A.CLAIMS_SQL}, {A.ACTIONS_SQL}, v AS (SELECT 'c/' || subject AS evidence_key, bool_and(len(evidence) > 0 AND status = 'Asserted') AS ok FROM claims WHERE predicate = 'signup' GROUP BY 1)
      SELECT event_id, coalesce(ok, false) AS justified FROM actions LEFT JOIN v USING (evidence_key)""",
    "escalation_text": f"WITH {A.ACTIONS_SQL} SELECT event_id, {_ESCALATION} AS escalation FROM actions",
    "manifest_verify": f"""WITH {A.MANIFESTS_SQL} SELECT path, state FROM (SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN e.digest <> a.digest OR e.bytes <> a.bytes THEN 'changed' END AS state
      FROM expected e FULL JOIN actual a ON e.path = a.path) WHERE state IS NOT NULL""",
    "known_answer_compare": f"""WITH {A.MANIFESTS_SQL} SELECT count(*) AS n, count(*) FILTER (same) AS same, bool_and(same) AS passed FROM (SELECT e.digest IS NOT DISTINCT FROM a.digest AS same FROM expected e LEFT JOIN actual a ON e.path = a.path)""",
    "retention_plan": f"""WITH {A.BACKUPS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY created DESC, backup) AS newest FROM backups)
      SELECT root, backup, newest, CASE WHEN held THEN 'keep: held' WHEN newest <= 2 THEN 'keep: minimum copies' WHEN created >= {RECENT} THEN 'keep: recent' ELSE 'prune' END AS decision FROM n""",
    "newest_backup": f"WITH {A.BACKUPS_SQL} SELECT root, backup, created FROM backups QUALIFY row_number() OVER (PARTITION BY root ORDER BY created DESC, backup) = 1",
}
