"""Queries over branches, commits and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import graph, merging, policy, versions
from tidemark.sources import adapters as A


def _records(spark, sf_dir):
    """The versions of keys on a branch, a commit a version, from the base and target states."""
    s = A.three_way(spark, sf_dir)
    base = s.where("side = 'base'")
    target = s.where("side = 'target'")
    first = base.select("key", F.lit(1).alias("seq"), F.lit("put").alias("op"), "kind", "counter", "body")
    second = target.select("key", F.lit(2).alias("seq"), F.lit("put").alias("op"), "kind", "counter", "body")
    gone = base.join(target.select("key"), "key", "left_anti").select("key", F.lit(2).alias("seq"), F.lit("del").alias("op"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("counter"), F.lit(None).cast("string").alias("body"))
    return first.unionByName(second).unionByName(gone)


RECORDS_SQL = A.SIDES_SQL + """,
records AS (
  SELECT key, 1 AS seq, 'put' AS op, kind, counter, body FROM sides WHERE side = 'base'
  UNION ALL SELECT key, 2, 'put', kind, counter, body FROM sides WHERE side = 'target'
  UNION ALL SELECT key, 2, 'del', NULL, NULL, NULL FROM sides WHERE side = 'base' AND key NOT IN (SELECT key FROM sides WHERE side = 'target')),
latest AS (SELECT * FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE op <> 'del')"""


def point_lookup(spark, sf_dir):
    return versions.latest(_records(spark, sf_dir).where(F.col("key") == "k/4"), ["key"]).select("key", "kind", "counter", "body")


def prefix_scan(spark, sf_dir):
    return versions.latest(_records(spark, sf_dir).where(F.col("key").startswith("k/1")), ["key"]).select("key", "kind")


def branch_scan_latest(spark, sf_dir):
    return versions.latest(_records(spark, sf_dir), ["key"]).select("key", "seq", "kind", "counter", "body")


def read_at_commit(spark, sf_dir):
    return versions.latest(versions.as_of_commit(_records(spark, sf_dir), 1), ["key"]).select("key", "kind", "counter", "body")


def rewind_state(spark, sf_dir):
    """What a rewind to the first commit takes back: keys that differ from the head, and both values."""
    r = _records(spark, sf_dir)
    old = versions.latest(versions.as_of_commit(r, 1), ["key"]).select("key", F.col("counter").alias("old_counter"), F.col("body").alias("old_body"))
    new = versions.latest(r, ["key"]).select("key", F.col("counter").alias("new_counter"), F.col("body").alias("new_body"))
    both = old.join(new, "key", "full_outer")
    return both.where(~(F.col("old_counter").eqNullSafe(F.col("new_counter")) & F.col("old_body").eqNullSafe(F.col("new_body"))))


def changed_keys_since_base(spark, sf_dir):
    """Keys that a side touched since the base, exactly; what a merge looks at."""
    s = A.three_way(spark, sf_dir)
    a = merging.aligned(s)
    b = F.col("base")
    return a.select("key", (~F.col("source").eqNullSafe(b)).alias("source_changed"), (~F.col("target").eqNullSafe(b)).alias("target_changed")).where("source_changed or target_changed")


def branch_visibility_after_fork(spark, sf_dir):
    """A fork sees what was written before it, and nothing of its sibling after."""
    s = A.three_way(spark, sf_dir)
    return s.where(F.col("side").isin("base", "source")).groupBy("key").agg(F.max(F.when(F.col("side") == "source", F.col("counter"))).alias("on_fork"), F.max(F.when(F.col("side") == "base", F.col("counter"))).alias("at_fork"))


def _plan(spark, sf_dir, p="conflict"):
    return merging.decided(A.three_way(spark, sf_dir), p)


def merge_counters(spark, sf_dir):
    return _plan(spark, sf_dir).where("outcome = 'counter'").select("key", F.col("merged.counter").alias("counter"))


def merge_sets(spark, sf_dir):
    return _plan(spark, sf_dir).where("outcome = 'set'").select("key", F.array_join("merged.members", ",").alias("members"))


def merge_claims(spark, sf_dir):
    return _plan(spark, sf_dir).where("outcome in ('claim_source', 'claim_target')").select("key", "outcome", F.col("merged.object").alias("object"), F.col("merged.valid_start").alias("valid_start"))


def merge_three_way(spark, sf_dir):
    return _plan(spark, sf_dir).select("key", "outcome", F.col("merged.kind").alias("kind"), F.col("merged.counter").alias("counter"), F.col("merged.body").alias("body"), F.col("merged.object").alias("object"))


def merge_conflicts(spark, sf_dir):
    return merging.conflicts(_plan(spark, sf_dir))


def merge_take_source(spark, sf_dir):
    return _plan(spark, sf_dir, "source").where("outcome = 'policy_source'").select("key", F.col("merged.body").alias("body"), F.col("merged.object").alias("object"))


def merge_summary(spark, sf_dir):
    p = _plan(spark, sf_dir)
    return p.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def merge_policy_veto(spark, sf_dir):
    """Writes of the merge with the verdict on each: one denial refuses the whole merge."""
    w = merging.writes(_plan(spark, sf_dir))
    label = F.pmod(F.expr("cast(substr(key, 3) as bigint)"), F.lit(4)).cast("int")
    action = F.when(F.col("merged.kind") == "claim", F.lit("identity.suspend_account")).when(F.col("merged.kind") == "set", F.lit("billing.refund")).otherwise(F.lit("crm.tag"))
    asked = w.select("key", F.lit("agent").alias("actor"), label.alias("label"), F.lit("authorize_action").alias("purpose"), action.alias("action"))
    return policy.decide(asked, A.rules(spark)).select("key", "decision", "rationale")


def merge_provenance_parents(spark, sf_dir):
    """Per merged key the nodes that produced it on the two sides, each only where that side counts."""
    w = merging.writes(_plan(spark, sf_dir))
    node = lambda side: F.concat(F.lit(f"{side}:"), F.col("key"))
    both = F.col("outcome").isin("counter", "set")
    return w.select("key", F.array_join(F.array_compact(F.array(F.when(both | F.col("outcome").isin("take_source", "claim_source"), node("source")), F.when(both | (F.col("outcome") == "claim_target"), node("target")))), ",").alias("parents"))


def commit_ancestors(spark, sf_dir):
    """Per last turn of a conversation, how many commits it descends from, itself included, and how deep."""
    c = A.commits(spark, sf_dir)
    last = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    heads = last.select(F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("last").cast("string")).alias("head"))
    return graph.ancestors(c, heads).groupBy("head").agg(F.count(F.lit(1)).alias("ancestors"), F.max("depth").cast("int").alias("depth"))


def _pairs(spark, sf_dir):
    """Pairs of last turns of neighbouring conversations."""
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    head = F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("last").cast("string"))
    one = c.select("conv_id", head.alias("a"))
    two = c.select((F.col("conv_id") - 1).alias("conv_id"), head.alias("b"))
    return one.join(two, "conv_id").select("a", "b")


def merge_base(spark, sf_dir):
    return graph.merge_bases(A.commits(spark, sf_dir), _pairs(spark, sf_dir))


def criss_cross_detect(spark, sf_dir):
    """Pairs with several lowest common ancestors: their merge is refused as ambiguous."""
    bases = graph.merge_bases(A.commits(spark, sf_dir), _pairs(spark, sf_dir))
    return bases.groupBy("a", "b").agg(F.count(F.lit(1)).alias("bases")).where("bases > 1")


def ref_state(spark, sf_dir):
    return versions.ref_state(A.ref_edits(spark, sf_dir))


def gc_roots(spark, sf_dir):
    return versions.gc_roots(versions.ref_state(A.ref_edits(spark, sf_dir)))


def gc_unreachable(spark, sf_dir):
    """Commits that no head or tag reaches, with the last turns of every third conversation as refs."""
    c = A.commits(spark, sf_dir)
    last = A.table(spark, sf_dir, "conversations").where(F.col("conv_id") % 3 == 0).groupBy("conv_id").agg(F.max("turn").alias("last"))
    roots = last.select(F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("last").cast("string")).alias("commit"))
    return c.select("commit").distinct().join(graph.reachable(c, roots), "commit", "left_anti")


QUERIES = {f.__name__: f for f in (point_lookup, prefix_scan, branch_scan_latest, read_at_commit, rewind_state, changed_keys_since_base, branch_visibility_after_fork, merge_counters, merge_sets, merge_claims, merge_three_way, merge_conflicts, merge_take_source, merge_summary, merge_policy_veto, merge_provenance_parents, commit_ancestors, merge_base, criss_cross_detect, ref_state, gc_roots, gc_unreachable)}

_REC = "{{kind: {0}.kind, counter: {0}.counter, members: {0}.members, body: {0}.body, object: {0}.object, vs: {0}.valid_start, ve: {0}.valid_end, mr: {0}.method_rank, cf: {0}.confidence}}"
_HAS = "{0}.key IS NOT NULL"


def _side(name: str) -> str:
    return f"(SELECT *, {_REC.format('x')} AS rec FROM sides x WHERE side = '{name}')"


MERGE_SQL = A.SIDES_SQL + f""",
al AS (
  SELECT key, b.rec AS b, s.rec AS s, t.rec AS t FROM {_side('base')} b FULL JOIN {_side('source')} s USING (key) FULL JOIN {_side('target')} t USING (key)),
winner AS (
  SELECT *, CASE WHEN NOT (coalesce(s.vs < t.ve, true) AND coalesce(t.vs < s.ve, true))
                 THEN CASE WHEN s.vs IS NULL OR t.vs IS NULL THEN NULL WHEN s.vs >= t.vs THEN 'source' ELSE 'target' END
                 WHEN s.mr > t.mr OR (s.mr = t.mr AND floor(s.cf * 1000000) > floor(t.cf * 1000000)) THEN 'source'
                 WHEN s.mr < t.mr OR (s.mr = t.mr AND floor(s.cf * 1000000) < floor(t.cf * 1000000)) THEN 'target' END AS w
  FROM al),
plan AS (
  SELECT *, CASE WHEN s IS NOT DISTINCT FROM t THEN 'none' WHEN s IS NOT DISTINCT FROM b THEN 'none'
                 WHEN t IS NOT DISTINCT FROM b THEN CASE WHEN s IS NULL THEN 'none' ELSE 'take_source' END
                 WHEN s IS NULL OR t IS NULL THEN 'conflict'
                 WHEN s.kind = t.kind AND s.kind = 'counter' THEN 'counter' WHEN s.kind = t.kind AND s.kind = 'set' THEN 'set'
                 WHEN s.kind = t.kind AND s.kind = 'claim' AND w IS NOT NULL THEN 'claim_' || w ELSE 'conflict' END AS outcome
  FROM winner),
merged AS (
  SELECT *, CASE WHEN outcome = 'counter' THEN coalesce(b.counter, 0) + (s.counter - coalesce(b.counter, 0)) + (t.counter - coalesce(b.counter, 0))
                 WHEN outcome IN ('take_source', 'claim_source') THEN s.counter WHEN outcome = 'claim_target' THEN t.counter END AS m_counter,
         CASE WHEN outcome IN ('take_source', 'claim_source', 'counter', 'set') THEN s.kind WHEN outcome = 'claim_target' THEN t.kind END AS m_kind,
         CASE WHEN outcome IN ('take_source', 'claim_source', 'counter', 'set') THEN s.body WHEN outcome = 'claim_target' THEN t.body END AS m_body,
         CASE WHEN outcome IN ('take_source', 'claim_source', 'counter', 'set') THEN s.object WHEN outcome = 'claim_target' THEN t.object END AS m_object,
         CASE WHEN outcome IN ('take_source', 'claim_source') THEN s.vs WHEN outcome = 'claim_target' THEN t.vs END AS m_start,
         CASE WHEN outcome = 'set' THEN list_sort(list_distinct(list_concat(s.members, t.members))) WHEN outcome = 'take_source' THEN s.members END AS m_members
  FROM plan),
writes AS (
  SELECT * FROM merged WHERE outcome IN ('counter', 'set', 'take_source', 'claim_source')
  AND NOT (outcome = 'counter' AND m_counter = t.counter) AND NOT (outcome = 'set' AND m_members = t.members))"""

_ALL_UP = """
up AS (SELECT h.head, h.head AS "commit", 0 AS depth FROM heads h
       UNION SELECT u.head, c.parent, u.depth + 1 FROM up u JOIN commits c ON c."commit" = u."commit")"""

_PAIRS_SQL = """
pp AS (SELECT a.conv_id || '.' || a.last AS a, b.conv_id || '.' || b.last AS b FROM lasts a JOIN lasts b ON b.conv_id = a.conv_id + 1),
names AS (SELECT DISTINCT "commit" AS head FROM commits UNION SELECT parent FROM commits),
reach AS (SELECT head, head AS "commit" FROM names UNION SELECT r.head, c.parent FROM reach r JOIN commits c ON c."commit" = r."commit"),
common AS (SELECT DISTINCT a, b, x."commit" AS base FROM pp JOIN reach x ON x.head = a JOIN reach y ON y.head = b AND y."commit" = x."commit"),
bases AS (SELECT * FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN reach r ON r.head = d.base AND r."commit" = c.base WHERE d.a = c.a AND d.b = c.b AND d.base <> c.base))"""

_STATE_SQL = A.REFS_SQL + """,
state AS (
  SELECT kind, name, target FROM (
    SELECT *, CASE WHEN op IN ('CreateBranch', 'SetHead') THEN 'branch' WHEN op IN ('SetTag', 'RemoveTag') THEN 'tag' END AS kind FROM ref_edits)
  WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY seq DESC, event_id DESC) = 1 AND op NOT LIKE 'Remove%')"""

SQL = {
    "point_lookup": f"WITH {RECORDS_SQL} SELECT key, kind, counter, body FROM latest WHERE key = 'k/4'",
    "prefix_scan": f"WITH {RECORDS_SQL} SELECT key, kind FROM latest WHERE starts_with(key, 'k/1')",
    "branch_scan_latest": f"WITH {RECORDS_SQL} SELECT key, seq, kind, counter, body FROM latest",
    "read_at_commit": f"WITH {RECORDS_SQL} SELECT key, kind, counter, body FROM records WHERE seq = 1",
    "rewind_state": f"""WITH {RECORDS_SQL}, o AS (SELECT key, counter AS old_counter, body AS old_body FROM records WHERE seq = 1), n AS (SELECT key, counter AS new_counter, body AS new_body FROM latest)
      SELECT key, old_counter, old_body, new_counter, new_body FROM o FULL JOIN n USING (key) WHERE old_counter IS DISTINCT FROM new_counter OR old_body IS DISTINCT FROM new_body""",
    "changed_keys_since_base": f"WITH {MERGE_SQL} SELECT key, s IS DISTINCT FROM b AS source_changed, t IS DISTINCT FROM b AS target_changed FROM al WHERE s IS DISTINCT FROM b OR t IS DISTINCT FROM b",
    "branch_visibility_after_fork": f"WITH {A.SIDES_SQL} SELECT key, max(counter) FILTER (side = 'source') AS on_fork, max(counter) FILTER (side = 'base') AS at_fork FROM sides WHERE side <> 'target' GROUP BY key",
    "merge_counters": f"WITH {MERGE_SQL} SELECT key, m_counter AS counter FROM merged WHERE outcome = 'counter'",
    "merge_sets": f"WITH {MERGE_SQL} SELECT key, array_to_string(m_members, ',') AS members FROM merged WHERE outcome = 'set'",
    "merge_claims": f"WITH {MERGE_SQL} SELECT key, outcome, m_object AS object, m_start AS valid_start FROM merged WHERE outcome LIKE 'claim_%'",
    "merge_three_way": f"WITH {MERGE_SQL} SELECT key, outcome, m_kind AS kind, m_counter AS counter, m_body AS body, m_object AS object FROM merged",
    "merge_conflicts": f"""WITH {MERGE_SQL} SELECT key, CASE WHEN s IS NULL THEN 'deleted in source, edited in target' WHEN t IS NULL THEN 'edited in source, deleted in target'
      WHEN s.kind <> t.kind THEN 'different kinds' WHEN s.kind = 'claim' THEN 'claims of equal standing disagree' ELSE 'both sides changed a ' || s.kind END AS reason FROM plan WHERE outcome = 'conflict'""",
    "merge_take_source": f"WITH {MERGE_SQL} SELECT key, s.body AS body, s.object AS object FROM plan WHERE outcome = 'conflict'",
    "merge_summary": f"WITH {MERGE_SQL} SELECT outcome, count(*) AS n FROM plan GROUP BY outcome",
    "merge_policy_veto": f"""WITH {MERGE_SQL}, {A.RULES_SQL},
      asked AS (SELECT key, 'agent' AS actor, CAST(CAST(substr(key, 3) AS BIGINT) % 4 AS INTEGER) AS label, 'authorize_action' AS purpose,
        CASE m_kind WHEN 'claim' THEN 'identity.suspend_account' WHEN 'set' THEN 'billing.refund' ELSE 'crm.tag' END AS action FROM writes),
      v AS (SELECT key, coalesce(bool_or(effect = 'Deny'), false) AS d, coalesce(bool_or(effect = 'Allow'), false) AS a FROM asked LEFT JOIN rules ON (r_actor IS NULL OR r_actor = actor) AND (r_label IS NULL OR r_label = label)
        AND (r_purpose IS NULL OR r_purpose = purpose) AND (r_action IS NULL OR r_action = action) GROUP BY key)
      SELECT key, CASE WHEN d OR NOT a THEN 'Deny' ELSE 'Allow' END AS decision, CASE WHEN d THEN 'a rule denies' WHEN a THEN 'a rule allows' ELSE 'no rule applies' END AS rationale FROM v""",
    "merge_provenance_parents": f"""WITH {MERGE_SQL} SELECT key, CASE WHEN outcome IN ('counter', 'set') THEN 'source:' || key || ',target:' || key ELSE 'source:' || key END AS parents FROM writes""",
    "commit_ancestors": f"""WITH RECURSIVE {A.COMMITS_SQL}, heads AS (SELECT conv_id || '.' || last AS head FROM lasts), {_ALL_UP},
      nearest AS (SELECT head, "commit", min(depth) AS depth FROM up GROUP BY ALL)
      SELECT head, count(*) AS ancestors, CAST(max(depth) AS INTEGER) AS depth FROM nearest GROUP BY head""",
    "merge_base": f"WITH RECURSIVE {A.COMMITS_SQL}, {_PAIRS_SQL} SELECT a, b, base FROM bases",
    "criss_cross_detect": f"WITH RECURSIVE {A.COMMITS_SQL}, {_PAIRS_SQL} SELECT a, b, count(*) AS bases FROM bases GROUP BY a, b HAVING count(*) > 1",
    "ref_state": f"WITH {_STATE_SQL} SELECT kind, name, target FROM state",
    "gc_roots": f'WITH {_STATE_SQL} SELECT DISTINCT target AS "commit" FROM state',
    "gc_unreachable": f"""WITH RECURSIVE {A.COMMITS_SQL},
      alive AS (SELECT conv_id || '.' || last AS "commit" FROM lasts WHERE conv_id % 3 = 0 UNION SELECT c.parent FROM alive a JOIN commits c ON c."commit" = a."commit")
      SELECT DISTINCT "commit" FROM commits WHERE "commit" NOT IN (SELECT "commit" FROM alive)""",
}
