"""Model tables from the test tables; every rule has the same form in Spark and in SQL (sql_views)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

DAY_MS = 86_400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str) -> Column:
    return X.millis(F.col(column))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim assertions from events: subject the user, predicate the event type, object the value."""
    e = table(spark, sf_dir, "events")
    known, eid = ms("ts"), F.col("event_id")
    return e.select(
        eid,
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_type").alias("predicate"),
        F.col("value").alias("object"),
        (known - (eid % 3) * DAY_MS).alias("valid_start"),
        F.when(eid % 5 == 0, known - (eid % 3) * DAY_MS + 30 * DAY_MS).alias("valid_end"),
        known.alias("known_start"),
        (eid % 6).cast("int").alias("method_rank"),
        (((eid * 7) % 101) / 100.0).alias("confidence"),
        F.concat(F.lit("cal-"), (F.col("user_id") % 2).cast("string")).alias("calibration"),
        F.when(eid % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("evt:"), (eid % 13).cast("string")))).alias("evidence"),
        F.when(eid % 17 == 0, F.lit("Stale")).when(eid % 23 == 0, F.lit("Contradicted")).otherwise(F.lit("Asserted")).alias("status"),
    )


CLAIMS_SQL = """
claims AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS subject, event_type AS predicate, value AS object,
         (epoch_us(ts) // 1000) - (event_id % 3) * 86400000 AS valid_start,
         CASE WHEN event_id % 5 = 0 THEN (epoch_us(ts) // 1000) - (event_id % 3) * 86400000 + 30 * CAST(86400000 AS BIGINT) END AS valid_end,
         (epoch_us(ts) // 1000) AS known_start, CAST(event_id % 6 AS INTEGER) AS method_rank,
         ((event_id * 7) % 101) / CAST(100.0 AS DOUBLE) AS confidence,
         'cal-' || CAST(user_id % 2 AS VARCHAR) AS calibration,
         CASE WHEN event_id % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['evt:' || CAST(event_id % 13 AS VARCHAR)] END AS evidence,
         CASE WHEN event_id % 17 = 0 THEN 'Stale' WHEN event_id % 23 = 0 THEN 'Contradicted' ELSE 'Asserted' END AS status
  FROM events)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivation nodes (node_id, branch, key, actor, parents, sources) of the order graph, on branches main and h1.

    Customers and suppliers cite their nation; orders derive from customers; lines from orders and suppliers.
    """
    empty = F.array().cast("array<string>")
    nation = lambda c: F.array(F.concat(F.lit("nation:"), F.col(c).cast("string")))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    c = table(spark, sf_dir, "customer").select(text("c/", "c_custkey").alias("node_id"), text("c/", "c_custkey").alias("key"), F.lit("crm").alias("actor"), empty.alias("parents"), nation("c_nationkey").alias("sources"), F.lit(True).alias("forked"))
    s = table(spark, sf_dir, "supplier").select(text("s/", "s_suppkey").alias("node_id"), text("s/", "s_suppkey").alias("key"), F.lit("erp").alias("actor"), empty.alias("parents"), nation("s_nationkey").alias("sources"), F.lit(True).alias("forked"))
    o = table(spark, sf_dir, "orders").select(text("o/", "o_orderkey").alias("node_id"), text("o/", "o_orderkey").alias("key"), F.lit("sales").alias("actor"), F.array(text("c/", "o_custkey")).alias("parents"), empty.alias("sources"), (F.col("o_orderkey") % 2 == 0).alias("forked"))
    key = F.concat(F.lit("l/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    row = F.concat_ws("/", key, F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), ms("l_shipdate").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"))
    l = table(spark, sf_dir, "lineitem").select(row.alias("node_id"), key.alias("key"), F.lit("sales").alias("actor"), F.array(text("o/", "l_orderkey"), text("s/", "l_suppkey")).alias("parents"), empty.alias("sources"), (F.col("l_orderkey") % 2 == 0).alias("forked"))
    every = c.unionByName(s).unionByName(o).unionByName(l)
    branches = F.when(F.col("forked"), F.array(F.lit("main"), F.lit("h1"))).otherwise(F.array(F.lit("main")))
    return every.select("node_id", F.explode(branches).alias("branch"), "key", "actor", "parents", "sources")


NODES_SQL = """
base_nodes AS (
  SELECT 'c/' || c_custkey AS node_id, 'c/' || c_custkey AS key, 'crm' AS actor, CAST([] AS VARCHAR[]) AS parents, ['nation:' || c_nationkey] AS sources, true AS forked FROM customer
  UNION ALL SELECT 's/' || s_suppkey, 's/' || s_suppkey, 'erp', [], ['nation:' || s_nationkey], true FROM supplier
  UNION ALL SELECT 'o/' || o_orderkey, 'o/' || o_orderkey, 'sales', ['c/' || o_custkey], [], o_orderkey % 2 = 0 FROM orders
  UNION ALL SELECT 'l/' || l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || (epoch_us(l_shipdate) // 1000) || '/' || CAST(round(l_extendedprice * 100) AS BIGINT),
                   'l/' || l_orderkey || '/' || l_linenumber, 'sales', ['o/' || l_orderkey, 's/' || l_suppkey], [], l_orderkey % 2 = 0 FROM lineitem),
nodes AS (
  SELECT node_id, 'main' AS branch, key, actor, parents, sources FROM base_nodes
  UNION ALL SELECT node_id, 'h1', key, actor, parents, sources FROM base_nodes WHERE forked),
seeds AS (SELECT branch, node_id FROM nodes WHERE list_contains(sources, 'nation:7')),
edges AS (SELECT branch, unnest(parents) AS parent, node_id FROM nodes),
flood AS (
  SELECT branch, node_id, 0 AS depth FROM seeds
  UNION SELECT e.branch, e.node_id, f.depth + 1 FROM flood f JOIN edges e ON e.branch = f.branch AND e.parent = f.node_id),
tainted AS (SELECT branch, node_id, min(depth) AS depth FROM flood GROUP BY ALL)"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action proposals from purchases."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    eid, uid = F.col("event_id"), F.col("user_id").cast("string")
    return e.select(
        eid,
        ms("ts").alias("arrived"),
        F.concat(uid, F.lit("/"), (eid % 50).cast("string")).alias("idempotency_key"),
        F.when(eid % 4 == 0, F.lit("identity.suspend_account")).when(eid % 4 == 1, F.lit("billing.refund")).when(eid % 4 == 2, F.lit("mail.send")).otherwise(F.lit("crm.tag")).alias("action_type"),
        F.concat(F.lit("c/"), uid).alias("target"),
        F.concat(F.lit("c/"), uid).alias("evidence_key"),
        (F.col("user_id") % 4).cast("int").alias("label"),
        (eid % 9 == 0).alias("simulation"),
        (eid % 5).cast("int").alias("outcome"),
        (eid % 13 != 0).alias("has_evidence"),
        F.concat(F.lit("t"), (F.col("user_id") % 10).cast("string")).alias("tenant"),
        F.when(eid % 4 == 0, F.lit("identity.reinstate_account")).when(eid % 4 == 1, F.lit("billing.charge")).alias("compensating_action"),
    )


ACTIONS_SQL = """
actions AS (
  SELECT event_id, (epoch_us(ts) // 1000) AS arrived, CAST(user_id AS VARCHAR) || '/' || CAST(event_id % 50 AS VARCHAR) AS idempotency_key,
         CASE event_id % 4 WHEN 0 THEN 'identity.suspend_account' WHEN 1 THEN 'billing.refund' WHEN 2 THEN 'mail.send' ELSE 'crm.tag' END AS action_type,
         'c/' || user_id AS target, 'c/' || user_id AS evidence_key, CAST(user_id % 4 AS INTEGER) AS label,
         event_id % 9 = 0 AS simulation, CAST(event_id % 5 AS INTEGER) AS outcome, event_id % 13 <> 0 AS has_evidence,
         't' || (user_id % 10) AS tenant,
         CASE event_id % 4 WHEN 0 THEN 'identity.reinstate_account' WHEN 1 THEN 'billing.charge' END AS compensating_action
  FROM events WHERE event_type = 'purchase')"""


def three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of a merge (side, key, kind, counter, members, body, claim columns) from orders; a deleted key has no row."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, F.lit("counter")).when(k % 4 == 1, F.lit("set")).when(k % 4 == 2, F.lit("text")).otherwise(F.lit("claim"))
    day = F.floor(ms("o_orderdate") / DAY_MS).cast("long")

    def side(name: str, step: int, moved: Column, gone: Column) -> DataFrame:
        d = F.when(moved, F.lit(step)).otherwise(F.lit(0)).cast("long")
        tag = F.concat(F.lit(name[0]), d.cast("string"))
        changed = d > 0
        return o.where(~gone).select(
            F.lit(name).alias("side"),
            F.concat(F.lit("k/"), k.cast("string")).alias("key"),
            kind.alias("kind"),
            F.when(kind == "counter", F.floor("o_totalprice").cast("long") + d).alias("counter"),
            F.when(kind == "set", F.array_sort(F.when(changed, F.array(F.lit("base"), tag)).otherwise(F.array(F.lit("base"))))).alias("members"),
            F.when(kind == "text", F.when(changed, F.concat(F.col("o_orderpriority"), F.lit("+"), tag)).otherwise(F.col("o_orderpriority"))).alias("body"),
            F.when(kind == "claim", F.when(changed, tag).otherwise(F.lit("base"))).alias("object"),
            F.when(kind == "claim", day + F.when(changed & (k % 3 == 0), d * 100).otherwise(F.lit(0))).alias("valid_start"),
            F.when((kind == "claim") & (k % 3 == 0), day + F.when(changed, d * 100).otherwise(F.lit(0)) + 50).alias("valid_end"),
            F.when(kind == "claim", ((k + d) % 6).cast("int")).alias("method_rank"),
            F.when(kind == "claim", ((k * 7 + d) % 101) / 100.0).alias("confidence"),
        )

    none = F.lit(False)
    return (
        side("base", 0, none, none)
        .unionByName(side("source", 3, k % 7 == 0, k % 13 == 0))
        .unionByName(side("target", 5, (k % 11 == 0) | (k % 7 == 0), k % 17 == 0))
    )


def _side_sql(name: str, step: int, moved: str, gone: str) -> str:
    d = f"CAST(CASE WHEN {moved} THEN {step} ELSE 0 END AS BIGINT)"
    return f"""
  SELECT '{name}' AS side, 'k/' || o_orderkey AS key, kind,
         CASE WHEN kind = 'counter' THEN CAST(floor(o_totalprice) AS BIGINT) + d END AS counter,
         CASE WHEN kind = 'set' THEN list_sort(CASE WHEN d > 0 THEN ['base', tag] ELSE ['base'] END) END AS members,
         CASE WHEN kind = 'text' THEN CASE WHEN d > 0 THEN o_orderpriority || '+' || tag ELSE o_orderpriority END END AS body,
         CASE WHEN kind = 'claim' THEN CASE WHEN d > 0 THEN tag ELSE 'base' END END AS object,
         CASE WHEN kind = 'claim' THEN day + CASE WHEN d > 0 AND o_orderkey % 3 = 0 THEN d * 100 ELSE 0 END END AS valid_start,
         CASE WHEN kind = 'claim' AND o_orderkey % 3 = 0 THEN day + CASE WHEN d > 0 THEN d * 100 ELSE 0 END + 50 END AS valid_end,
         CASE WHEN kind = 'claim' THEN CAST((o_orderkey + d) % 6 AS INTEGER) END AS method_rank,
         CASE WHEN kind = 'claim' THEN ((o_orderkey * 7 + d) % 101) / CAST(100.0 AS DOUBLE) END AS confidence
  FROM (SELECT *, '{name[0]}' || d AS tag FROM (
    SELECT *, {d} AS d, CASE o_orderkey % 4 WHEN 0 THEN 'counter' WHEN 1 THEN 'set' WHEN 2 THEN 'text' ELSE 'claim' END AS kind,
           (epoch_us(o_orderdate) // 1000) // 86400000 AS day FROM orders)) WHERE NOT ({gone})"""


SIDES_SQL = "sides AS (" + " UNION ALL ".join([
    _side_sql("base", 0, "false", "false"),
    _side_sql("source", 3, "o_orderkey % 7 = 0", "o_orderkey % 13 = 0"),
    _side_sql("target", 5, "o_orderkey % 11 = 0 OR o_orderkey % 7 = 0", "o_orderkey % 17 = 0"),
]) + ")"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, parent) edges of a commit DAG from conversations; roots have the parent "root"."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    name = lambda conv, turn: F.concat(conv.cast("string"), F.lit("."), turn.cast("string"))
    chain = c.select(name(F.col("conv_id"), F.col("turn")).alias("commit"), F.when(F.col("turn") == 0, F.lit("root")).otherwise(name(F.col("conv_id"), F.col("turn") - 1)).alias("parent"))
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    peer = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last").alias("peer_last"))
    pairs = last.join(peer, "conv_id").withColumn("next", F.col("conv_id") + 1)
    plain = pairs.where(F.col("conv_id") % 10 == 0).select(name(F.col("conv_id"), F.col("last")), name(F.col("next"), F.col("peer_last")))
    crossing = pairs.where((F.col("conv_id") % 10 == 5) & (F.col("last") >= 1) & (F.col("peer_last") >= 1))
    one = crossing.select(name(F.col("conv_id"), F.col("last")), name(F.col("next"), F.col("peer_last") - 1))
    two = crossing.select(name(F.col("next"), F.col("peer_last")), name(F.col("conv_id"), F.col("last") - 1))
    return chain.union(plain).union(one).union(two)


COMMITS_SQL = """
turns AS (SELECT DISTINCT conv_id, turn FROM conversations),
lasts AS (SELECT conv_id, max(turn) AS last FROM turns GROUP BY conv_id),
pairs AS (SELECT a.conv_id AS c, a.last AS al, b.last AS bl FROM lasts a JOIN lasts b ON b.conv_id = a.conv_id + 1),
commits AS (
  SELECT conv_id || '.' || turn AS "commit", CASE WHEN turn = 0 THEN 'root' ELSE conv_id || '.' || (turn - 1) END AS parent FROM turns
  UNION ALL SELECT c || '.' || al, (c + 1) || '.' || bl FROM pairs WHERE c % 10 = 0
  UNION ALL SELECT c || '.' || al, (c + 1) || '.' || (bl - 1) FROM pairs WHERE c % 10 = 5 AND al >= 1 AND bl >= 1
  UNION ALL SELECT (c + 1) || '.' || bl, c || '.' || (al - 1) FROM pairs WHERE c % 10 = 5 AND al >= 1 AND bl >= 1)"""


def ref_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ref edits in order: (seq, op, name, target) from events."""
    op = F.when(F.col("event_type") == "signup", F.lit("CreateBranch")).when(F.col("event_type") == "view", F.lit("SetHead")).when(F.col("event_type") == "click", F.lit("SetTag")).when(F.col("event_type") == "error", F.lit("RemoveTag")).otherwise(F.lit("RecordCommit"))
    return table(spark, sf_dir, "events").select(
        (ms("ts") * 1000 + F.col("event_id") % 1000).alias("seq"), F.col("event_id"), op.alias("op"), F.col("user_id").cast("string").alias("name"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("target")
    )


REFS_SQL = """
ref_edits AS (
  SELECT (epoch_us(ts) // 1000) * 1000 + event_id % 1000 AS seq, event_id,
         CASE event_type WHEN 'signup' THEN 'CreateBranch' WHEN 'view' THEN 'SetHead' WHEN 'click' THEN 'SetTag' WHEN 'error' THEN 'RemoveTag' ELSE 'RecordCommit' END AS op,
         CAST(user_id AS VARCHAR) AS name, 'm' || event_id AS target FROM events)"""


def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries (doc_id, key, text, embedding, citation, stale, label) from documents, embeddings and labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return (
        d.join(e, "doc_id", "left")
        .join(l, "doc_id", "left")
        .select(
            "doc_id",
            F.format_string("obs/doc/%012d", "doc_id").alias("key"),
            F.coalesce("text", F.lit("")).alias("text"),
            "embedding",
            X.source_display(F.col("source"), F.col("doc_id").cast("string")).alias("citation"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("stale"),
            _source_trust(F.col("source")).alias("label"),
        )
    )


def _source_trust(source: Column) -> Column:
    """Trust level from the digits of a source's name; untrusted where there are none."""
    return F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT)") % 4, F.lit(3)).cast("int")


INDEX_SQL = """
index_entries AS (
  SELECT d.doc_id, 'obs/doc/' || lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS key, coalesce(d.text, '') AS text, e.embedding,
         d.source || ':' || d.doc_id AS citation, coalesce(l.toxic, 0) = 1 AS stale,
         CAST(coalesce(TRY_CAST(regexp_extract(d.source, '([0-9]+)$', 1) AS BIGINT) % 4, 3) AS INTEGER) AS label
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id)"""

#: (actor, label, purpose, action, effect); null matches anything. The rule set of the influence tests.
RULES = [
    (None, 3, "authorize_action", "identity.suspend_account", "Deny"),
    (None, 3, "public_answer", "pack_into_context", "Deny"),
    (None, 2, "authorize_action", "billing.refund", "Deny"),
    ("guest", None, None, "mail.send", "Deny"),
    (None, None, None, "crm.tag", "Allow"),
    (None, None, "authorize_action", None, "Allow"),
    (None, None, "public_answer", None, "Allow"),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "r_actor string, r_label int, r_purpose string, r_action string, effect string")


RULES_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in RULES
) + ") AS t(r_actor, r_label, r_purpose, r_action, effect))"


def manifests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) files of a backup from pages: some missing, some altered, some added."""
    p = table(spark, sf_dir, "pages")
    path = F.concat(F.col("page_id").cast("string"), F.lit("@"), F.coalesce("url", F.lit("")))
    html = F.coalesce("html", F.lit(""))
    expected = p.select("page_id", path.alias("path"), F.length(html).cast("long").alias("bytes"), F.sha2(html, 256).alias("digest"))
    altered = F.when(F.col("page_id") % 23 == 0, F.sha2(F.col("digest"), 256)).otherwise(F.col("digest"))
    actual = expected.where(F.col("page_id") % 19 != 0).select("page_id", "path", "bytes", altered.alias("digest"))
    added = expected.where(F.col("page_id") % 29 == 0).select("page_id", F.concat("path", F.lit(".copy")).alias("path"), "bytes", "digest")
    return expected, actual.unionByName(added)


MANIFESTS_SQL = """
expected AS (SELECT page_id, page_id || '@' || coalesce(url, '') AS path, CAST(length(coalesce(html, '')) AS BIGINT) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
actual AS (
  SELECT page_id, path, bytes, CASE WHEN page_id % 23 = 0 THEN sha256(digest) ELSE digest END AS digest FROM expected WHERE page_id % 19 <> 0
  UNION ALL SELECT page_id, path || '.copy', bytes, digest FROM expected WHERE page_id % 29 = 0)"""


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.col("o_orderkey").alias("backup"), ms("o_orderdate").alias("created"), (F.col("o_orderkey") % 37 == 0).alias("held"))


BACKUPS_SQL = """
backups AS (SELECT o_custkey AS root, o_orderkey AS backup, (epoch_us(o_orderdate) // 1000) AS created, o_orderkey % 37 = 0 AS held FROM orders)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of sessions from conversations: user and system turns read, assistant turns write."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("session"), "turn", (F.col("role") == "assistant").alias("is_write"), F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("node"), ((F.col("conv_id") + F.col("turn")) % 4).cast("int").alias("label"))


SESSION_SQL = """
session_events AS (
  SELECT conv_id AS session, turn, role = 'assistant' AS is_write, conv_id || '.' || turn AS node, CAST((conv_id + turn) % 4 AS INTEGER) AS label
  FROM conversations)"""
