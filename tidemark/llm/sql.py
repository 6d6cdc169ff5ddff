"""SQL for two of the corpus operators: the mixture simulated slot by slot, and repeats looked up window by window."""

_TWO_64 = "CAST(18446744073709551616 AS UHUGEINT)"
#: The primes of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def _times(a: str, b: int) -> str:
    return f"(CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {_TWO_64}"


def _turned(a: str, n: int) -> str:
    """Rotated to the left by n bits."""
    return f"((CAST({a} AS UHUGEINT) * CAST({1 << n} AS UHUGEINT)) % {_TWO_64} + CAST({a} AS UHUGEINT) // CAST({1 << 64 - n} AS UHUGEINT))"


def _xor(a: str, b: str) -> str:
    return f"xor(CAST({a} AS UBIGINT), CAST({b} AS UBIGINT))"


#: XXH64 (seed 42) of doc_id as a long, step by step; the key that orders a source's documents.
_KEYS_SQL = f"""
h0 AS (SELECT doc_id, source, CAST(CASE WHEN doc_id < 0 THEN CAST(doc_id AS HUGEINT) + 18446744073709551616 ELSE coalesce(doc_id, 0) END AS UHUGEINT) AS x FROM documents),
h1 AS (SELECT doc_id, source, {_times('x', _P[1])} AS x FROM h0),
h2 AS (SELECT doc_id, source, {_times(_turned('x', 31), _P[0])} AS x FROM h1),
h3 AS (SELECT doc_id, source, {_xor('x', f'{42 + _P[4] + 8}')} AS x FROM h2),
h4 AS (SELECT doc_id, source, ({_times(_turned('x', 27), _P[0])} + {_P[3]}) % {_TWO_64} AS x FROM h3),
h5 AS (SELECT doc_id, source, {_times(_xor('x', f'x // {1 << 33}'), _P[1])} AS x FROM h4),
h6 AS (SELECT doc_id, source, {_times(_xor('x', f'x // {1 << 29}'), _P[2])} AS x FROM h5),
h7 AS (SELECT doc_id, source, {_xor('x', f'x // {1 << 32}')} AS x FROM h6),
keyed AS (SELECT doc_id, source, CASE WHEN doc_id IS NULL THEN 42 WHEN x >= 9223372036854775808 THEN CAST(x AS HUGEINT) - 18446744073709551616 ELSE CAST(x AS HUGEINT) END AS key FROM h7)"""

OP5_SQL = f"""
WITH RECURSIVE {_KEYS_SQL},
ranked AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - 1 AS rank FROM keyed),
sizes AS (SELECT source, count(*) AS n, greatest(CAST(round_even(sqrt(count(*)) * 1000, 0) AS BIGINT), 1) AS weight FROM documents GROUP BY source),
whole AS (SELECT source, n, weight // (SELECT list_reduce(list(weight), lambda a, b: gcd(a, b)) FROM sizes) AS share FROM sizes),
one AS (
  SELECT list(source ORDER BY source NULLS FIRST) AS names, list(share ORDER BY source NULLS FIRST) AS share, CAST(sum(share) AS BIGINT) AS period, CAST(sum(share) AS BIGINT) <= greatest(1000, 10 * count(*)) AS short,
         list(CAST(ceil(n / 16.0) AS BIGINT) ORDER BY source NULLS FIRST) AS n_blocks FROM whole),
given AS (SELECT names, share, period, short, CASE WHEN short THEN share ELSE n_blocks END AS have FROM one),
sim AS (
  SELECT CAST(0 AS BIGINT) AS now, list_transform(have, lambda x: CAST(0 AS BIGINT)) AS had, CAST(NULL AS BIGINT) AS k, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS block FROM given
  UNION ALL
  SELECT step + 1, list_transform(had, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), CAST(pick AS BIGINT), step, had[pick]
  FROM (
    SELECT step, had, list_sort(list_transform(list_filter(todo, lambda o: o.released <= step), lambda o: {{due: o.due, k: o.k}}))[1].k AS pick
    FROM (
      SELECT had, todo, greatest(now, list_min(list_transform(todo, lambda o: o.released))) AS step
      FROM (
        SELECT now, had, list_filter(list_transform(had, lambda x, i: {{k: i, free: x < have[i], released: x * period // share[i], due: ((x + 1) * period + share[i] - 1) // share[i]}}), lambda o: o.free) AS todo
        FROM sim, given) WHERE len(todo) > 0))),
slots AS (SELECT names[k] AS source, k, slot, block FROM sim, given WHERE k IS NOT NULL),
placed AS (
  SELECT r.doc_id, r.source, r.rank, r.rank // 16 AS block, s.slot + CASE WHEN short THEN r.rank // 16 // share[s.k] * period ELSE 0 END AS slot
  FROM ranked r CROSS JOIN given JOIN slots s ON s.source IS NOT DISTINCT FROM r.source AND s.block = CASE WHEN short THEN r.rank // 16 % share[s.k] ELSE r.rank // 16 END)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, row_number() OVER (ORDER BY slot, rank) - 1 AS mix_rank FROM placed
"""

#: Every window of 400 bytes by its hash; texts are held as hexadecimal digits, two for each byte.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM d WHERE length(x) >= 800)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
marked AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM hit)),
spans AS (SELECT r, g, min(i) AS a, max(i) + 400 AS b FROM marked GROUP BY r, g),
bounds AS (SELECT r, a, b, lead(a) OVER (PARTITION BY r ORDER BY a) AS next_a FROM spans),
kept AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, min(a) AS first_a, string_agg(substr(x, 2 * b + 1, CASE WHEN next_a IS NULL THEN length(x) ELSE 2 * (next_a - b) END), '' ORDER BY a) AS rest
  FROM bounds JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN rest IS NULL THEN x ELSE substr(x, 1, 2 * first_a) || rest END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
