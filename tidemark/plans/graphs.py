"""Queries over the derivation graph: taint, recall, stale marks, forgetting, read-sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import graph, recall
from tidemark.plans import governance
from tidemark.sources import adapters as A

SOURCE = "nation:7"


def taint_seeds(spark, sf_dir):
    return graph.seeds_of(A.nodes(spark, sf_dir), SOURCE)


def source_seek(spark, sf_dir):
    """Nodes by the source they cite, over exploded sources."""
    n = A.nodes(spark, sf_dir)
    return n.select("branch", "key", F.explode("sources").alias("source")).groupBy("branch", "source").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


def taint_flood(spark, sf_dir):
    return recall.tainted(A.nodes(spark, sf_dir), SOURCE).select("branch", "node_id", "depth")


def taint_by_branch_stats(spark, sf_dir):
    n = A.nodes(spark, sf_dir)
    hit = recall.tainted(n, SOURCE).groupBy("branch").agg(F.count(F.lit(1)).alias("contaminated"))
    every = n.groupBy("branch").agg(F.count(F.lit(1)).alias("examined"))
    return every.join(hit, "branch", "left").select("branch", "examined", F.coalesce("contaminated", F.lit(0)).alias("contaminated"))


def taint_paths(spark, sf_dir):
    """Chains of conversation turns from a cited source: depth and the way back to it."""
    n = _chains(spark, sf_dir)
    found = recall.tainted(n, "conv:3", with_path=True)
    return found.select("branch", "node_id", "depth", F.array_join("path", ">").alias("path"))


def _chains(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    node = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("."), t.cast("string"))
    empty = F.array().cast("array<string>")
    return c.select(
        F.lit("main").alias("branch"),
        node(F.col("turn")).alias("node_id"),
        node(F.col("turn")).alias("key"),
        F.when(F.col("turn") > 0, F.array(node(F.col("turn") - 1))).otherwise(empty).alias("parents"),
        F.when(F.col("turn") == 0, F.array(F.concat(F.lit("conv:"), (F.col("conv_id") % 7).cast("string")))).otherwise(empty).alias("sources"),
    )


def derived_via(spark, sf_dir):
    n = _chains(spark, sf_dir)
    return graph.derived_via(n, recall.tainted(n, "conv:3"), "conv:3").select("node_id", F.array_join("via", ">").alias("via"))


def contaminated_keys(spark, sf_dir):
    return recall.contaminated_keys(A.nodes(spark, sf_dir), SOURCE)


def contaminated_union(spark, sf_dir):
    return recall.contaminated_keys(A.nodes(spark, sf_dir), SOURCE).select("key").distinct()


def _claims(spark, sf_dir):
    return A.claims(spark, sf_dir).select(F.concat(F.lit("c/"), F.col("subject")).alias("key"), "event_id", "status")


def mark_stale(spark, sf_dir):
    return recall.mark_stale(_claims(spark, sf_dir), recall.contaminated_keys(A.nodes(spark, sf_dir), SOURCE)).select("key", "event_id", "status")


def forget_report(spark, sf_dir):
    keys = recall.contaminated_keys(A.nodes(spark, sf_dir), SOURCE)
    entries = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("key"))
    return recall.forget_report(entries, _claims(spark, sf_dir), keys)


def recall_plan(spark, sf_dir):
    p = recall.plan(A.nodes(spark, sf_dir), governance.executed_actions_frame(spark, sf_dir), SOURCE)
    return p.select("section", "branch", "key", "actor", "depth", "action_type", "target", "action_id", "compensating_action", "escalation", "derived_via")


def plan_predicates(spark, sf_dir):
    """Counts and flags of a recall plan: size, whether it is all reversible, whether a human must decide."""
    p = recall_plan(spark, sf_dir)
    irreversible = F.col("section") == "irreversible"
    return p.agg(
        F.count(F.lit(1)).alias("size"),
        (F.count(F.when(irreversible, 1)) == 0).alias("fully_reversible"),
        F.coalesce(F.bool_or(irreversible & F.col("compensating_action").isNull()), F.lit(False)).alias("needs_human"),
    )


def read_set_fold(spark, sf_dir):
    e = recall.read_epochs(A.session_events(spark, sf_dir)).where(F.col("written").isNotNull())
    return e.select("session", "written", F.array_join("parents", ",").alias("parents"))


def label_propagation(spark, sf_dir):
    """A write's label: the most restrictive of what was read for it and its own."""
    e = recall.read_epochs(A.session_events(spark, sf_dir)).where(F.col("written").isNotNull())
    return e.select("session", "written", F.greatest("read_label", "own_label").alias("label"))


def derivation_nodes(spark, sf_dir):
    """A node for each write, its id a hash over branch, key and the sorted parents."""
    e = recall.read_epochs(A.session_events(spark, sf_dir)).where(F.col("written").isNotNull())
    return e.select("session", "written", X.content_id(F.col("session"), F.col("written"), F.array_join("parents", ",")).alias("node_id"))


def latest_node(spark, sf_dir):
    """The last node that wrote each key of a branch."""
    n = A.nodes(spark, sf_dir)
    return n.groupBy("branch", "key").agg(F.max("node_id").alias("node_id"), F.count(F.lit(1)).alias("written"))


QUERIES = {f.__name__: f for f in (taint_seeds, source_seek, taint_flood, taint_by_branch_stats, taint_paths, derived_via, contaminated_keys, contaminated_union, mark_stale, forget_report, recall_plan, plan_predicates, read_set_fold, label_propagation, derivation_nodes, latest_node)}

CHAINS_SQL = """
turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
walk AS (SELECT conv_id, turn, 0 AS depth, conv_id || '.' || turn AS path FROM turns WHERE turn = 0 AND conv_id % 7 = 3
         UNION ALL SELECT t.conv_id, t.turn, w.depth + 1, w.path || '>' || t.conv_id || '.' || t.turn FROM walk w JOIN turns t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1),
back AS (SELECT conv_id, turn AS place, turn, conv_id || '.' || turn AS via FROM walk
         UNION ALL SELECT conv_id, place - 1, turn, via || '>' || conv_id || '.' || (place - 1) FROM back WHERE place > 0)"""

RECALL_SQL = f"""{A.NODES_SQL}, {governance.DECIDED_SQL},
ways AS (
  SELECT branch, node_id, 0 AS depth, [node_id] AS path FROM seeds
  UNION SELECT e.branch, e.node_id, w.depth + 1, list_append(w.path, e.node_id) FROM ways w JOIN edges e ON e.branch = w.branch AND e.parent = w.node_id),
shortest AS (SELECT w.branch, w.node_id, w.depth, array_to_string(min(w.path), '>') AS via FROM ways w JOIN tainted USING (branch, node_id, depth) GROUP BY w.branch, w.node_id, w.depth),
every_hit AS (SELECT n.branch, n.key, n.actor, t.depth, t.via FROM nodes n JOIN shortest t ON t.branch = n.branch AND t.node_id = n.node_id),
hit AS (SELECT branch, key, actor, min(depth) AS depth, arg_min(via, {{d: depth, v: via}}) AS via FROM every_hit GROUP BY ALL),
hit_keys AS (SELECT key, arg_min(via, {{d: depth, v: via}}) AS via FROM every_hit GROUP BY key),
recall AS (
  SELECT 'irreversible' AS section, CAST(NULL AS VARCHAR) AS branch, evidence_key AS key, CAST(NULL AS VARCHAR) AS actor, CAST(NULL AS INTEGER) AS depth, action_type, target, action_id, compensating_action,
         CASE WHEN compensating_action IS NOT NULL THEN split_part(action_type, '.', -1) || ' on ' || target || ' can''t be undone; compensate with ' || compensating_action
              ELSE split_part(action_type, '.', -1) || ' on ' || target || ' can''t be undone; a human must decide' END AS escalation, via AS derived_via
  FROM decided JOIN hit_keys ON hit_keys.key = evidence_key WHERE status = 'Succeeded'
  UNION ALL SELECT 'reversible', branch, key, actor, CAST(depth AS INTEGER), NULL, NULL, NULL, NULL, NULL, via FROM hit)"""

EPOCHS_SQL = A.SESSION_SQL + """,
epochs AS (
  SELECT session, epoch, max(node) FILTER (is_write) AS written, coalesce(array_to_string(list_sort(list(DISTINCT node) FILTER (NOT is_write)), ','), '') AS parents,
         max(label) FILTER (NOT is_write) AS read_label, max(label) FILTER (is_write) AS own_label
  FROM (SELECT *, coalesce(sum(CAST(is_write AS INTEGER)) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM session_events)
  GROUP BY session, epoch HAVING max(node) FILTER (is_write) IS NOT NULL)"""

CLAIM_KEYS_SQL = A.CLAIMS_SQL + ", claim_keys AS (SELECT 'c/' || subject AS key, event_id, status FROM claims)"

SQL = {
    "taint_seeds": f"WITH RECURSIVE {A.NODES_SQL} SELECT branch, node_id FROM seeds",
    "source_seek": f"WITH RECURSIVE {A.NODES_SQL}, s AS (SELECT branch, key, unnest(sources) AS source FROM nodes) SELECT branch, source, count(*) AS n, min(key) AS first_key FROM s GROUP BY ALL",
    "taint_flood": f"WITH RECURSIVE {A.NODES_SQL} SELECT branch, node_id, depth FROM tainted",
    "taint_by_branch_stats": f"WITH RECURSIVE {A.NODES_SQL} SELECT branch, examined, coalesce(contaminated, 0) AS contaminated FROM (SELECT branch, count(*) AS examined FROM nodes GROUP BY branch) LEFT JOIN (SELECT branch, count(*) AS contaminated FROM tainted GROUP BY branch) USING (branch)",
    "taint_paths": f"WITH RECURSIVE {CHAINS_SQL} SELECT 'main' AS branch, conv_id || '.' || turn AS node_id, depth, path FROM walk",
    "derived_via": f"WITH RECURSIVE {CHAINS_SQL} SELECT conv_id || '.' || turn AS node_id, via FROM back WHERE place = 0",
    "contaminated_keys": f"WITH RECURSIVE {A.NODES_SQL} SELECT DISTINCT branch, key FROM nodes JOIN tainted USING (branch, node_id)",
    "contaminated_union": f"WITH RECURSIVE {A.NODES_SQL} SELECT DISTINCT key FROM nodes JOIN tainted USING (branch, node_id)",
    "mark_stale": f"WITH RECURSIVE {A.NODES_SQL}, {CLAIM_KEYS_SQL} SELECT key, event_id, 'Stale' AS status FROM claim_keys WHERE status = 'Asserted' AND key IN (SELECT key FROM nodes JOIN tainted USING (branch, node_id))",
    "forget_report": f"""WITH RECURSIVE {A.NODES_SQL}, {CLAIM_KEYS_SQL}, k AS (SELECT DISTINCT key FROM nodes JOIN tainted USING (branch, node_id))
      SELECT (SELECT count(*) FROM customer WHERE 'c/' || c_custkey IN (SELECT key FROM k)) AS deindexed, (SELECT count(*) FROM claim_keys WHERE status <> 'Invalidated' AND key IN (SELECT key FROM k)) AS invalidated""",
    "recall_plan": f"WITH RECURSIVE {RECALL_SQL} SELECT * FROM recall",
    "plan_predicates": f"""WITH RECURSIVE {RECALL_SQL} SELECT count(*) AS size, count(*) FILTER (section = 'irreversible') = 0 AS fully_reversible,
      coalesce(bool_or(section = 'irreversible' AND compensating_action IS NULL), false) AS needs_human FROM recall""",
    "read_set_fold": f"WITH {EPOCHS_SQL} SELECT session, written, parents FROM epochs",
    "label_propagation": f"WITH {EPOCHS_SQL} SELECT session, written, greatest(read_label, own_label) AS label FROM epochs",
    "derivation_nodes": f"""WITH {EPOCHS_SQL}, t AS (SELECT *, CAST(session AS VARCHAR) AS s FROM epochs)
      SELECT session, written, sha256(length(s) || '|' || s || length(written) || '|' || written || length(parents) || '|' || parents) AS node_id FROM t""",
    "latest_node": f"WITH RECURSIVE {A.NODES_SQL} SELECT branch, key, max(node_id) AS node_id, count(*) AS written FROM nodes GROUP BY ALL",
}
