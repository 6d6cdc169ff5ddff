"""Queries over claims: intervals, histories, as-of, eligibility, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import temporal
from tidemark.sources import adapters as A

#: 2024-01-15 00:00 UTC, inside the events.
NOW = 1_705_276_800_000
WEEK = 7 * A.DAY_MS
#: Beyond all times: an unknown bound.
FAR = 1 << 62


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.history(A.claims(spark, sf_dir), ["known_start", "event_id"])


HISTORY_SQL = A.CLAIMS_SQL + """,
history AS (
  SELECT *, row_number() OVER w - 1 AS seq, lead(known_start) OVER w AS known_end,
         CASE WHEN lead(1) OVER w IS NOT NULL THEN 'Superseded' ELSE status END AS version_status
  FROM claims WINDOW w AS (PARTITION BY subject, predicate ORDER BY known_start, event_id))"""


def interval_contains(spark, sf_dir):
    c = A.claims(spark, sf_dir)
    return c.where(X.contains(F.col("valid_start"), F.col("valid_end"), F.lit(NOW))).select("event_id", "subject", "predicate", "valid_start", "valid_end")


def interval_overlap_contradictions(spark, sf_dir):
    """Claims of one key with bounded, overlapping validity and different objects.

    Each claim is laid over spans of ten days; the later of a pair starts within one span of the
    earlier, so an equality join on (key, span) finds every pair once. Claims without an end would
    overlap all later ones of their key; those are counted by claim in open_overlap_contradictions, not listed in pairs.
    """
    c = A.claims(spark, sf_dir).where(F.col("valid_end").isNotNull()).select("subject", "predicate", "event_id", "object", "valid_start", "valid_end")
    left = c.select("subject", "predicate", F.explode(F.sequence(F.floor(F.col("valid_start") / (10 * A.DAY_MS)), F.floor((F.col("valid_end") - 1) / (10 * A.DAY_MS)))).alias("span"), F.col("event_id").alias("a"), F.col("object").alias("object_a"), F.col("valid_start").alias("start_a"), F.col("valid_end").alias("end_a"))
    right = c.select("subject", "predicate", F.floor(F.col("valid_start") / (10 * A.DAY_MS)).alias("span"), F.col("event_id").alias("b"), F.col("object").alias("object_b"), F.col("valid_start").alias("start_b"), F.col("valid_end").alias("end_b"))
    # The later start lies in the earlier interval: each pair is found once, from its earlier claim.
    first = (F.col("start_a") < F.col("start_b")) | ((F.col("start_a") == F.col("start_b")) & (F.col("a") < F.col("b")))
    return left.join(right, ["subject", "predicate", "span"]).where(first & X.overlaps(F.col("start_a"), F.col("end_a"), F.col("start_b"), F.col("end_b")) & (F.col("object_a") != F.col("object_b"))).select("subject", "predicate", "a", "b")


def _overlapping(points, keys):
    """event_id and how many claims of its keys start before its end, less those that end by its start; itself among them."""
    w = Window.partitionBy(*keys).orderBy("at")
    begun = F.count(F.when(F.col("opens"), 1)).over(w.rangeBetween(Window.unboundedPreceding, -1))
    over = F.count(F.when(~F.col("opens"), 1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return points.select("event_id", F.when(F.col("opens"), -over).otherwise(begun).alias("n"))


def open_overlap_contradictions(spark, sf_dir):
    """For every claim, open-ended ones too, the number of claims of its key whose validity overlaps its own and whose
    object is another, and the first such claim after it (by start and id; -1 for none).

    An unknown bound overlaps everything. Pairs would grow with the square of a key's claims; counts come from sorted
    starts and ends instead: those of the key, less those of the key with the same object.
    """
    c = A.claims(spark, sf_dir).where(F.col("object").isNotNull()).select("subject", "predicate", "event_id", "object", F.coalesce("valid_start", F.lit(-FAR)).alias("lo"), F.coalesce("valid_end", F.lit(FAR)).alias("hi"))
    points = c.select("subject", "predicate", "object", "event_id", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("hi").alias("at"), F.lit(False).alias("opens")))).alias("p")).select("*", "p.*")
    n = _overlapping(points, ["subject", "predicate"]).unionByName(_overlapping(points, ["subject", "predicate", "object"]).withColumn("n", -F.col("n")))
    counts = n.groupBy(F.col("event_id").alias("of_event")).agg(F.sum("n").alias("n_contradictions"))
    # From the last claim back: the next one with another object is the neighbour's, or what stood after the neighbour.
    back = Window.partitionBy("subject", "predicate").orderBy(F.desc("lo"), F.desc("event_id"))
    after = F.when(F.lag("object").over(back) != F.col("object"), F.struct(F.lag("event_id").over(back).alias("id"), F.lag("lo").over(back).alias("lo")))
    following = c.withColumn("after", after).withColumn("after", F.last("after", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    met = F.when(F.col("after.lo") < F.col("hi"), F.col("after.id"))
    return following.join(counts, following["event_id"] == counts["of_event"]).select("event_id", "subject", "predicate", "n_contradictions", F.coalesce(met, F.lit(-1)).cast("long").alias("next_contradiction"))


def claim_history_close(spark, sf_dir):
    return _history(spark, sf_dir).select("event_id", "subject", "predicate", "seq", "known_start", "known_end", "version_status")


def asof_single(spark, sf_dir):
    return temporal.as_of(_history(spark, sf_dir), NOW, NOW + WEEK).select("subject", "predicate", "event_id", "object", "seq", "version_status", "valid_at", "known_at")


def asof_batch(spark, sf_dir):
    h = _history(spark, sf_dir)
    at = h.select("subject", "predicate").distinct().select("*", F.explode(F.array(*[F.lit(NOW + k * WEEK) for k in (-1, 0, 1)])).alias("valid_at"))
    at = at.select("*", F.explode(F.array(*[F.lit(NOW + k * WEEK) for k in (0, 1)])).alias("known_at"))
    return temporal.as_of_batch(h, at).select("subject", "predicate", "valid_at", "known_at", "event_id", "seq")


def late_arrival_split(spark, sf_dir):
    c = A.claims(spark, sf_dir)
    delay = F.col("known_start") - F.col("valid_start")
    late = F.when(delay == 0, F.lit("on time")).when(delay <= A.DAY_MS, F.lit("a day late")).otherwise(F.lit("later"))
    return c.groupBy("predicate", late.alias("arrival")).agg(F.count(F.lit(1)).alias("n"), F.min("known_start").alias("first_known"))


def superseded_versions(spark, sf_dir):
    return _history(spark, sf_dir).groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("versions"), F.count(F.when(F.col("version_status") == "Superseded", 1)).alias("superseded"), F.max("seq").alias("last_seq"))


def action_eligibility(spark, sf_dir):
    return A.claims(spark, sf_dir).select("event_id", X.eligible(F.col("evidence"), F.col("status")).alias("eligible"))


def ineligibility_reasons(spark, sf_dir):
    c = A.claims(spark, sf_dir).withColumn("reason", X.ineligibility(F.col("evidence"), F.col("status")))
    return c.where(F.col("reason").isNotNull()).select("event_id", "reason")


def confidence_combine(spark, sf_dir):
    """The least confidence of a subject's claims of one predicate, if all are comparable; else null."""
    c = A.claims(spark, sf_dir).withColumn("pair", F.struct("method_rank", "calibration"))
    one = F.count_distinct("pair") == 1
    return c.groupBy("subject", "predicate").agg(F.when(one, F.min(X.clamp(F.col("confidence")))).alias("combined"), F.count_distinct("pair").alias("kinds"))


def provenance_rank_winner(spark, sf_dir):
    c = A.claims(spark, sf_dir)
    best = F.max(F.struct(X.tiebreak(F.col("method_rank"), F.col("confidence")).alias("t"), F.col("event_id")))
    return c.groupBy("subject", "predicate").agg(best.alias("b")).select("subject", "predicate", F.col("b.event_id").alias("event_id"), X.method_name(F.col("b.t.rank")).alias("method"), F.col("b.t.millionths").alias("millionths"))


def history_lookup(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.where((F.col("subject") == "7") & (F.col("predicate") == "purchase")).select("seq", "event_id", "object", "known_start", "known_end")


def next_sequence(spark, sf_dir):
    return _history(spark, sf_dir).groupBy("subject", "predicate").agg((F.max("seq") + 1).alias("next_seq"))


def interval_builders(spark, sf_dir):
    c = A.claims(spark, sf_dir)
    from_, between = X.interval(F.col("valid_start"), None), X.interval(F.col("valid_start"), F.col("valid_end"))
    closed = X.closed_at(F.col("valid_start"), F.col("known_start"))
    return c.select("event_id", from_["start"].alias("from_start"), from_["end"].alias("from_end"), between["end"].alias("between_end"), closed["end"].alias("closed_end"), X.contains(closed["start"], closed["end"], F.col("known_start")).alias("holds_at_end"))


def ids_and_displays(spark, sf_dir):
    c = A.claims(spark, sf_dir)
    cid = X.content_id(F.col("subject"), F.col("predicate"), F.col("known_start"))
    return c.select("event_id", cid.alias("claim_id"), F.left(cid, F.lit(8)).alias("short_id"), X.action_id(F.concat(F.col("subject"), F.lit("/"), F.col("predicate"))).alias("action_id"), X.source_display(F.lit("evt"), F.col("event_id").cast("string")).alias("display"), X.method_name(F.col("method_rank")).alias("method"), X.trust_name(F.col("event_id") % 4).alias("trust"), X.trust_level(X.trust_name(F.col("event_id") % 4)).alias("trust_back"), X.method_rank(X.method_name(F.col("method_rank"))).alias("rank_back"))


def record_descriptions(spark, sf_dir):
    """A line for people about each record: plain values, texts cut at 60 characters, claims, observations, nodes."""
    none = F.lit(None)
    v = A.three_way(spark, sf_dir).where("side = 'base' and kind <> 'claim'")
    values = v.select("key", X.describe_value(F.col("kind"), none, F.col("counter"), F.col("members"), none, F.col("body"), none).alias("line"))
    d = A.table(spark, sf_dir, "documents")
    texts = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("key"), X.shortened(F.coalesce("text", F.lit(""))).alias("line"))
    c, eid = A.claims(spark, sf_dir), F.col("event_id")
    about = X.describe_claim(F.col("subject"), F.col("predicate"), F.concat(F.lit("event "), eid.cast("string")), X.method_name(F.col("method_rank")), F.col("confidence"), F.size("evidence"), F.col("status"))
    seen = X.describe_observation(F.concat(F.lit("evt:"), eid.cast("string")), eid % 4)
    node = X.describe_node(F.lit("agent"), F.concat(F.lit("c/"), F.col("subject")), F.col("predicate"))
    lines = F.explode(F.array(*[F.struct(F.concat(F.lit(p), eid.cast("string")).alias("key"), x.alias("line")) for p, x in (("c/", about), ("o/", seen), ("n/", node))]))
    return values.unionByName(texts).unionByName(c.select(lines.alias("x")).select("x.*"))


def record_projections(spark, sf_dir):
    """What every record shows: additive kind, value in any wrapper, citations, staleness."""
    c = A.claims(spark, sf_dir)
    kind = F.when(F.col("event_id") % 3 == 0, F.lit("observation")).when(F.col("event_id") % 3 == 1, F.lit("claim")).otherwise(F.lit("value"))
    source = F.concat(F.lit("evt:"), F.col("event_id").cast("string"))
    return c.withColumn("kind", kind).select(
        "event_id",
        "kind",
        X.additive(F.when(F.col("event_id") % 2 == 0, F.lit("counter")).otherwise(F.lit("text"))).alias("is_additive"),
        F.when(F.col("kind") == "observation", F.lit(None)).otherwise(F.col("object")).alias("shown"),
        F.array_join(X.citations(F.col("kind"), source, F.col("evidence")), ",").alias("cites"),
        ((F.col("kind") == "claim") & (F.col("status") == "Stale")).alias("is_stale"),
        ((F.col("kind") == "claim") & (F.col("status") == "Asserted")).alias("may_go_stale"),
    )


def read_windows(spark, sf_dir):
    """Extension: tumbling windows over events, the batch form of the streaming query."""
    e = A.table(spark, sf_dir, "events")
    hour = F.floor(A.ms("ts") / 3_600_000).cast("long")
    return e.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


QUERIES = {f.__name__: f for f in (interval_contains, interval_overlap_contradictions, open_overlap_contradictions, claim_history_close, asof_single, asof_batch, late_arrival_split, superseded_versions, action_eligibility, ineligibility_reasons, confidence_combine, provenance_rank_winner, history_lookup, next_sequence, interval_builders, ids_and_displays, record_descriptions, record_projections, read_windows)}

_ASOF = "(valid_start IS NULL OR {v} >= valid_start) AND (valid_end IS NULL OR {v} < valid_end) AND (known_start IS NULL OR {k} >= known_start) AND (known_end IS NULL OR {k} < known_end)"
_METHOD = "CASE {0} WHEN 5 THEN 'Direct' WHEN 4 THEN 'Human' WHEN 3 THEN 'Rule' WHEN 2 THEN 'Statistical' WHEN 1 THEN 'Imported' ELSE 'LanguageModel' END"
_FRAMED = "length({0}) || '|' || {0}"

SQL = {
    "interval_contains": f"WITH {A.CLAIMS_SQL} SELECT event_id, subject, predicate, valid_start, valid_end FROM claims WHERE {NOW} >= valid_start AND (valid_end IS NULL OR {NOW} < valid_end)",
    "open_overlap_contradictions": f"""WITH {A.CLAIMS_SQL}, c AS (SELECT *, coalesce(valid_start, -{1 << 62}) AS lo, coalesce(valid_end, {1 << 62}) AS hi FROM claims WHERE object IS NOT NULL)
      SELECT x.event_id, x.subject, x.predicate, count(y.event_id) AS n_contradictions,
        coalesce(arg_min(y.event_id, (y.lo, y.event_id)) FILTER ((y.lo, y.event_id) > (x.lo, x.event_id)), -1) AS next_contradiction
      FROM c x LEFT JOIN c y ON x.subject = y.subject AND x.predicate = y.predicate AND x.object <> y.object AND x.lo < y.hi AND y.lo < x.hi
      GROUP BY ALL""",
    "interval_overlap_contradictions": f"""WITH {A.CLAIMS_SQL}, c AS (SELECT * FROM claims WHERE valid_end IS NOT NULL)
      SELECT x.subject, x.predicate, x.event_id AS a, y.event_id AS b FROM c x JOIN c y ON x.subject = y.subject AND x.predicate = y.predicate
      AND (x.valid_start < y.valid_start OR (x.valid_start = y.valid_start AND x.event_id < y.event_id))
      AND x.valid_start < y.valid_end AND y.valid_start < x.valid_end AND x.object <> y.object""",
    "claim_history_close": f"WITH {HISTORY_SQL} SELECT event_id, subject, predicate, seq, known_start, known_end, version_status FROM history",
    "asof_single": f"""WITH {HISTORY_SQL}, q AS (SELECT * FROM history WHERE {_ASOF.format(v=NOW, k=NOW + WEEK)})
      SELECT subject, predicate, event_id, object, seq, version_status, CAST({NOW} AS BIGINT) AS valid_at, CAST({NOW + WEEK} AS BIGINT) AS known_at
      FROM q QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY seq DESC) = 1""",
    "asof_batch": f"""WITH {HISTORY_SQL},
      coords AS (SELECT subject, predicate, v AS valid_at, k AS known_at FROM (SELECT DISTINCT subject, predicate FROM history),
             (SELECT unnest([{NOW - WEEK}, {NOW}, {NOW + WEEK}]) AS v), (SELECT unnest([{NOW}, {NOW + WEEK}]) AS k))
      SELECT subject, predicate, valid_at, known_at, event_id, seq FROM history JOIN coords USING (subject, predicate) WHERE {_ASOF.format(v='valid_at', k='known_at')}
      QUALIFY row_number() OVER (PARTITION BY subject, predicate, valid_at, known_at ORDER BY seq DESC) = 1""",
    "late_arrival_split": f"""WITH {A.CLAIMS_SQL} SELECT predicate, CASE WHEN known_start = valid_start THEN 'on time' WHEN known_start - valid_start <= 86400000 THEN 'a day late' ELSE 'later' END AS arrival,
      count(*) AS n, min(known_start) AS first_known FROM claims GROUP BY ALL""",
    "superseded_versions": f"WITH {HISTORY_SQL} SELECT subject, predicate, count(*) AS versions, count(*) FILTER (version_status = 'Superseded') AS superseded, max(seq) AS last_seq FROM history GROUP BY ALL",
    "action_eligibility": f"WITH {A.CLAIMS_SQL} SELECT event_id, len(evidence) > 0 AND status = 'Asserted' AS eligible FROM claims",
    "ineligibility_reasons": f"""WITH {A.CLAIMS_SQL} SELECT event_id, CASE WHEN len(evidence) = 0 THEN 'claim has no evidence' WHEN status = 'Stale' THEN 'claim is stale: a source it rests on is in doubt'
      ELSE 'claim is ' || status || ', not Asserted' END AS reason FROM claims WHERE len(evidence) = 0 OR status <> 'Asserted'""",
    "confidence_combine": f"""WITH {A.CLAIMS_SQL} SELECT subject, predicate, CASE WHEN count(DISTINCT method_rank || calibration) = 1 THEN min(least(greatest(confidence, 0.0), 1.0)) END AS combined,
      count(DISTINCT method_rank || calibration) AS kinds FROM claims GROUP BY ALL""",
    "provenance_rank_winner": f"""WITH {A.CLAIMS_SQL} SELECT subject, predicate, event_id, {_METHOD.format('method_rank')} AS method, CAST(floor(confidence * 1000000) AS BIGINT) AS millionths FROM claims
      QUALIFY row_number() OVER (PARTITION BY subject, predicate ORDER BY method_rank DESC, floor(confidence * 1000000) DESC, event_id DESC) = 1""",
    "history_lookup": f"WITH {HISTORY_SQL} SELECT seq, event_id, object, known_start, known_end FROM history WHERE subject = '7' AND predicate = 'purchase'",
    "next_sequence": f"WITH {HISTORY_SQL} SELECT subject, predicate, max(seq) + 1 AS next_seq FROM history GROUP BY ALL",
    "interval_builders": f"""WITH {A.CLAIMS_SQL} SELECT event_id, valid_start AS from_start, CAST(NULL AS BIGINT) AS from_end, valid_end AS between_end, known_start AS closed_end, false AS holds_at_end FROM claims""",
    "record_descriptions": f"""WITH {A.SIDES_SQL}, {A.CLAIMS_SQL}, t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
      SELECT key, CASE kind WHEN 'counter' THEN 'counter ' || counter WHEN 'set' THEN 'set of ' || len(members) ELSE '"' || body || '"' END AS line FROM sides WHERE side = 'base' AND kind <> 'claim'
      UNION ALL SELECT 'd/' || doc_id, CASE WHEN length(text) <= 60 THEN '"' || text || '"' ELSE '"' || left(text, 60) || '..." (' || length(text) || ' characters)' END FROM t
      UNION ALL SELECT 'c/' || event_id, subject || ' ' || predicate || ' = event ' || event_id || ' (' || {_METHOD.format('method_rank')} || ', ' || CAST(floor(confidence * 100) AS BIGINT) || '%, evidence ' || len(evidence) || ', ' || status || ')' FROM claims
      UNION ALL SELECT 'o/' || event_id, 'observed from evt:' || event_id || ' (' || ['VerifiedSystem', 'Human', 'ThirdParty', 'Untrusted'][event_id % 4 + 1] || ')' FROM claims
      UNION ALL SELECT 'n/' || event_id, 'agent wrote c/' || subject || ': "' || predicate || '"' FROM claims""",
    "ids_and_displays": f"""WITH {A.CLAIMS_SQL}, i AS (SELECT *, sha256({_FRAMED.format('subject')} || {_FRAMED.format('predicate')} || {_FRAMED.format('CAST(known_start AS VARCHAR)')}) AS cid FROM claims)
      SELECT event_id, cid AS claim_id, left(cid, 8) AS short_id, 'act-' || left(sha256(subject || '/' || predicate), 16) AS action_id, 'evt:' || event_id AS display, {_METHOD.format('method_rank')} AS method,
      CASE event_id % 4 WHEN 0 THEN 'VerifiedSystem' WHEN 1 THEN 'Human' WHEN 2 THEN 'ThirdParty' ELSE 'Untrusted' END AS trust, CAST(event_id % 4 AS INTEGER) AS trust_back, method_rank AS rank_back FROM i""",
    "record_projections": f"""WITH {A.CLAIMS_SQL}, r AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'observation' WHEN 1 THEN 'claim' ELSE 'value' END AS kind FROM claims)
      SELECT event_id, kind, event_id % 2 = 0 AS is_additive, CASE WHEN kind <> 'observation' THEN object END AS shown,
      CASE kind WHEN 'observation' THEN 'evt:' || event_id WHEN 'claim' THEN coalesce(array_to_string(evidence, ','), '') ELSE '' END AS cites,
      kind = 'claim' AND status = 'Stale' AS is_stale, kind = 'claim' AND status = 'Asserted' AS may_go_stale FROM r""",
    "read_windows": "SELECT (epoch_us(ts) // 1000) // 3600000 AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
}
