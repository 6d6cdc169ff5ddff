"""Queries over the index: terms, scores, packing, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import retrieval, vectors
from tidemark.operators.custody import percentiles
from tidemark.operators.versions import latest
from tidemark.sources import adapters as A

QUERY = "the order of anan, the trash"
TERMS = retrieval.tokenize(QUERY)
#: A query vector made of whole numbers, so that it is the same on any engine.
VECTOR = [float((k * 7) % 11 - 5) for k in range(64)]


def tokenize_terms(spark, sf_dir):
    words = A.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(X.terms(F.coalesce("text", F.lit("")))).alias("place", "term"))
    return words.select("item_id", F.col("place").cast("long").alias("place"), "term")


def token_cost(spark, sf_dir):
    return A.index_entries(spark, sf_dir).select("key", X.token_cost(F.col("text")).alias("cost"))


def score_text(spark, sf_dir):
    return A.index_entries(spark, sf_dir).select("key", F.round(X.text_score(F.col("text"), TERMS), 6).alias("score"))


def score_blend(spark, sf_dir):
    return retrieval.scored(A.index_entries(spark, sf_dir), QUERY, VECTOR).select("key", F.round("score", 6).alias("score"))


def stale_penalty(spark, sf_dir):
    s = retrieval.scored(A.index_entries(spark, sf_dir), QUERY)
    return s.groupBy("stale").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 6).alias("best"))


def _packed(spark, sf_dir, budget):
    entries = retrieval.may_pack(A.index_entries(spark, sf_dir), A.rules(spark), "agent", "public_answer")
    return retrieval.pack(retrieval.scored(entries, QUERY), budget)


def pack_context(spark, sf_dir):
    return _packed(spark, sf_dir, 2_000).where("packed").select("key", "pack_rank", F.round("score", 6).alias("score"), "cost")


def pack_tiny_budget(spark, sf_dir):
    return retrieval.totals(_packed(spark, sf_dir, 50))


def retrieve_filtered(spark, sf_dir):
    """Policy, then the caller's predicate, then scores: the best candidates before packing."""
    entries = retrieval.may_pack(A.index_entries(spark, sf_dir), A.rules(spark), "agent", "public_answer")
    s = retrieval.scored(entries, QUERY, where=~F.col("stale") & (F.col("label") < 2))
    return s.where("score > 0").select("key", "label", F.round("score", 6).alias("score"), "citation")


def cosine_pairs(spark, sf_dir):
    """Cosine of neighbouring vectors."""
    e = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    j = e.join(other, "vec_id")
    return j.select("vec_id", F.round(X.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"), F.round(X.dot(F.col("embedding"), F.col("next")), 6).alias("dot"), F.round(X.norm(X.unit(F.col("embedding"))), 6).alias("unit_norm"))


def _keyed(spark, sf_dir):
    return A.table(spark, sf_dir, "embeddings").select(F.format_string("v/%012d", "vec_id").alias("key"), "vec_id", "embedding")


def knn_exact(spark, sf_dir):
    return vectors.exact(_keyed(spark, sf_dir), VECTOR, 10).select("key", F.round("similarity", 6).alias("similarity"), "rank")


def knn_exact_batch(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    queries = k.where(F.col("vec_id") % 50 == 0).select(F.col("key").alias("query"), F.col("embedding").alias("vector"))
    return vectors.exact_batch(k, queries, 5).select("query", "key", F.round("similarity", 6).alias("similarity"), "rank")


def _buffer(spark, sf_dir):
    """Rows written since the index was built: every 40th key again, with its vector reversed."""
    k = _keyed(spark, sf_dir)
    return k.where(F.col("vec_id") % 40 == 0).select("key", F.reverse("embedding").alias("embedding"))


def ann_union_buffer(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    live = vectors.union_buffer(k.select(F.lit(0).alias("cell"), "key", "embedding"), _buffer(spark, sf_dir))
    return vectors.exact(live, VECTOR, 20).select("key", F.round("similarity", 6).alias("similarity"), "rank")


def ann_ivf_search(spark, sf_dir):
    k = _keyed(spark, sf_dir)
    c = vectors.centroids(k)
    return vectors.search(vectors.assign(k, c), c, _buffer(spark, sf_dir), VECTOR, 10)


def ann_recall(spark, sf_dir):
    """Recall@10 of the inverted file as ann_ivf_search uses it, its own probes and buffer, over every 50th vector,
    against the exact search over the same rows."""
    k, buffer = _keyed(spark, sf_dir), _buffer(spark, sf_dir)
    c = vectors.centroids(k)
    cells = vectors.assign(k, c)
    queries = k.where(F.col("vec_id") % 50 == 0).select(F.col("key").alias("query"), F.col("embedding").alias("vector"))
    found = vectors.search_batch(cells, c, buffer, queries, 10)
    return vectors.recall(found, vectors.exact_batch(vectors.union_buffer(cells, buffer), queries, 10))


def graph_levels(spark, sf_dir):
    """How many vectors a layered neighbour graph would have on each level, by the hash of their keys."""
    return _keyed(spark, sf_dir).groupBy(X.graph_level(F.col("key")).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first_key"))


def latency_percentiles(spark, sf_dir):
    """Median, 95th and 99th percentile of the events' values by type, as of latencies."""
    p = percentiles(A.table(spark, sf_dir, "events"), "event_type", "value")
    return p.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


def index_snapshot(spark, sf_dir):
    """The entries that a branch shows: the last write of each key, tombstones gone."""
    e = A.index_entries(spark, sf_dir).select("key", "citation", "label", "doc_id")
    first = e.select("*", F.lit(1).alias("seq"), F.lit("put").alias("op"))
    again = e.where(F.col("doc_id") % 7 == 0).select("key", "citation", F.lit(3).alias("label"), "doc_id", F.lit(2).alias("seq"), F.lit("put").alias("op"))
    gone = e.where(F.col("doc_id") % 11 == 0).select("key", "citation", "label", "doc_id", F.lit(3).alias("seq"), F.lit("del").alias("op"))
    return latest(first.unionByName(again).unionByName(gone), ["key"]).select("key", "citation", "label", "seq")


def index_on_write(spark, sf_dir):
    """Entries that a batch of writes makes from its hints: uncited records are refused."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source")
    hints = A.table(spark, sf_dir, "labels").select("doc_id", F.col("quality")).distinct()
    kind = F.when(F.col("doc_id") % 3 == 0, F.lit("observation")).when(F.col("doc_id") % 3 == 1, F.lit("claim")).otherwise(F.lit("value"))
    source = F.concat(F.col("source"), F.lit(":"), F.col("doc_id").cast("string"))
    cites = X.citations(kind, source, F.when(F.col("doc_id") % 2 == 0, F.array(source)).otherwise(F.array().cast("array<string>")))
    return docs.join(hints, "doc_id", "left").where(F.col("quality").isNotNull()).select("doc_id", F.array_join(cites, ",").alias("cites"), F.size(cites).alias("n")).where("n > 0").drop("n")


QUERIES = {f.__name__: f for f in (tokenize_terms, token_cost, score_text, score_blend, stale_penalty, pack_context, pack_tiny_budget, retrieve_filtered, cosine_pairs, knn_exact, knn_exact_batch, ann_union_buffer, ann_ivf_search, ann_recall, graph_levels, latency_percentiles, index_snapshot, index_on_write)}

_TEXT = "(" + " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN CAST(1 AS DOUBLE) ELSE 0 END" for t in TERMS) + f") / {len(TERMS)}"
_VEC = "[" + ", ".join(str(x) for x in VECTOR) + "]::DOUBLE[]"
_COS = "list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[])"
_COST = "CAST(ceil(length(text) / 4) + 1 AS BIGINT)"
_SCORED = A.INDEX_SQL + f""",
scored AS (SELECT *, round(CASE WHEN stale THEN 0.25 ELSE 1 END * ({_TEXT}), 9) AS score, {_COST} AS cost FROM index_entries)"""


def _pack_sql(budget: int) -> str:
    return _SCORED + f""",
allowed AS (SELECT * FROM scored WHERE label <> 3),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS n FROM allowed WHERE cost <= {budget}),
fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, 0 AS taken, false AS packed
         UNION ALL SELECT r.n, CASE WHEN f.used + r.cost <= {budget} THEN f.used + r.cost ELSE f.used END, f.taken + CASE WHEN f.used + r.cost <= {budget} THEN 1 ELSE 0 END, f.used + r.cost <= {budget}
         FROM fold f JOIN ranked r ON r.n = f.n + 1),
packed AS (SELECT key, score, cost, stale, taken FROM fold JOIN ranked USING (n) WHERE packed)"""


_KEYED = "keyed AS (SELECT 'v/' || lpad(CAST(vec_id AS VARCHAR), 12, '0') AS key, vec_id, embedding FROM embeddings)"

SQL = {
    "tokenize_terms": r"""SELECT item_id, CAST(generate_subscripts(ws, 1) - 1 AS BIGINT) AS place, unnest(ws) AS term FROM (
      SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark)""",
    "token_cost": f"WITH {A.INDEX_SQL} SELECT key, {_COST} AS cost FROM index_entries",
    "score_text": f"WITH {A.INDEX_SQL} SELECT key, round({_TEXT}, 6) AS score FROM index_entries",
    "score_blend": f"WITH {A.INDEX_SQL} SELECT key, round(CASE WHEN stale THEN 0.25 ELSE 1 END * (coalesce(({_COS.format('embedding', _VEC)} + 1) / 2, 0) + {_TEXT}), 6) AS score FROM index_entries",
    "stale_penalty": f"WITH {_SCORED} SELECT stale, count(*) AS n, round(max(score), 6) AS best FROM scored GROUP BY stale",
    "pack_context": f"WITH RECURSIVE {_pack_sql(2_000)} SELECT key, CAST(taken AS INTEGER) AS pack_rank, round(score, 6) AS score, cost FROM packed",
    "pack_tiny_budget": f"""WITH RECURSIVE {_pack_sql(50)} SELECT (SELECT count(*) FROM allowed) AS considered, (SELECT count(*) FROM packed) AS n_packed, CAST((SELECT coalesce(sum(cost), 0) FROM packed) AS BIGINT) AS used,
      (SELECT count(*) FROM allowed) - (SELECT count(*) FROM packed) AS dropped, (SELECT coalesce(bool_or(stale), false) FROM packed) AS contains_stale""",
    "retrieve_filtered": f"WITH {_SCORED} SELECT key, label, round(score, 6) AS score, citation FROM scored WHERE label <> 3 AND NOT stale AND label < 2 AND score > 0",
    "cosine_pairs": f"""SELECT a.vec_id, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS cosine, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot,
      CAST(1.0 AS DOUBLE) AS unit_norm FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "knn_exact": f"""WITH {_KEYED}, s AS (SELECT key, round({_COS.format('embedding', _VEC)}, 9) AS s FROM keyed)
      SELECT key, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
    "knn_exact_batch": f"""WITH {_KEYED}, s AS (SELECT q.key AS query, k.key, round({_COS.format('q.embedding', 'k.embedding')}, 9) AS s FROM keyed q, keyed k WHERE q.vec_id % 50 = 0)
      SELECT query, key, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY s DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""",
    "ann_union_buffer": f"""WITH {_KEYED}, live AS (SELECT key, CASE WHEN vec_id % 40 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM keyed),
      s AS (SELECT key, round({_COS.format('embedding', _VEC)}, 9) AS s FROM live) SELECT key, round(s, 6) AS similarity, CAST(row_number() OVER (ORDER BY s DESC, key) AS INTEGER) AS rank FROM s QUALIFY rank <= 20""",
    "graph_levels": f"""WITH {_KEYED}, l AS (SELECT key, CAST(floor(-ln((CAST('0x' || left(sha256(key), 13) AS BIGINT) + 0.5) / 4503599627370496) / ln(16.0)) AS INTEGER) AS level FROM keyed)
      SELECT level, count(*) AS n, min(key) AS first_key FROM l GROUP BY level""",
    "latency_percentiles": """SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99
      FROM events GROUP BY event_type""",
    "index_snapshot": f"""WITH {A.INDEX_SQL} SELECT key, citation, CAST(CASE WHEN doc_id % 7 = 0 THEN 3 ELSE label END AS INTEGER) AS label, CAST(CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 1 END AS INTEGER) AS seq FROM index_entries WHERE doc_id % 11 <> 0""",
    "index_on_write": """SELECT d.doc_id, source || ':' || d.doc_id AS cites FROM documents d JOIN (SELECT DISTINCT doc_id, quality FROM labels) l USING (doc_id)
      WHERE quality IS NOT NULL AND (d.doc_id % 3 = 0 OR (d.doc_id % 3 = 1 AND d.doc_id % 2 = 0))""",
}
