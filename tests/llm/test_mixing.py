from fractions import Fraction

import pytest

from tidemark.llm import mixing


@pytest.mark.parametrize("quota", [{"a": 1}, {"a": 5, "b": 3, None: 2}, {f"s{i}": i + 1 for i in range(30)}, {"a": 997, "b": 1, "c": 2}])
def test_less_than_one_block_off(quota):
    slots, total = mixing.schedule(quota), sum(quota.values())
    assert {s: slots.count(s) for s in quota} == quota
    had = dict.fromkeys(quota, 0)
    for t, s in enumerate(slots, 1):
        had[s] += 1
        assert all(abs(Fraction(q, total) * t - had[x]) < 1 for x, q in quota.items())


def test_quotas_sum_and_follow_weights():
    got = mixing.quotas({"a": 3, "b": 1, "c": Fraction(1, 1000)}, 1000)
    assert sum(got.values()) == 1000 and min(got.values()) >= 1 and abs(got["a"] - 750) <= 2


def brute(rows, weights, block, period, key):
    """The mixture simulated document by document."""
    by = {}
    for d, s in rows:
        by.setdefault(s, []).append(d)
    for s in by:
        by[s].sort(key=lambda d: (key[d], d))
    quota = mixing.quotas({s: weights[s] for s in by}, max(period, 10 * len(by)))
    slots, out, at, slot = mixing.schedule(quota), [], dict.fromkeys(by, 0), 0
    while len(out) < len(rows):
        s = slots[slot % len(slots)]
        for d in by[s][at[s] * block : (at[s] + 1) * block]:
            out.append((d, s, at[s], slot, len(out)))
        at[s] += 1
        slot += 1
    return set(out)


@pytest.mark.parametrize("range_rows", [20_000, 7])
def test_against_simulation(spark, range_rows):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else None)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string").selectExpr("*", "'x' as slot", "1 as rank")
    key = {r.doc_id: r.k for r in df.selectExpr("doc_id", "xxhash64(doc_id) k").collect()}
    weights = {"hot": 1, "b": 2, None: 3}
    got = mixing.mix(df, weights, block=8, period=20, range_rows=range_rows).collect()
    assert {(r.doc_id, r.source, r.block, r.slot, r.mix_rank) for r in got} == brute(rows, weights, 8, 20, key)
    laid = [r.doc_id for r in mixing.ordered(df, weights).select("doc_id").collect()]
    assert sorted(laid) == list(range(400))


def test_defined_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mixing.mix(empty).count() == 0 and mixing.ordered(empty).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, source string")
    assert sorted(r.mix_rank for r in mixing.mix(twice).collect()) == [0, 1, 2]
    assert mixing.ordered(twice).count() == 3


def test_follows_the_given_weights_over_a_whole_run(spark):
    """A third for one source and the rest for a hundred others: no multiple of a tenth of the slots is dealt out evenly."""
    weights = {"hot": Fraction(1, 3)} | {f"s{i}": Fraction(2 * (i + 1), 3 * 5050) for i in range(100)}
    sizes = {s: 2 * int(600 * w) + 2 for s, w in weights.items()}
    rows = [(s, k) for s, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, source string")
    got = sorted((r.mix_rank, r.slot, r.source, r.block) for r in mixing.mix(df, weights, block=2).collect())
    assert [r[0] for r in got] == list(range(len(rows)))
    assert [r[1] for r in got] == sorted(r[1] for r in got) and len({r[1] for r in got}) == len({r[2:] for r in got})
    first = min(max(r[1] for r in got if r[2] == s) for s in sizes)  # the first exhaustion
    slots = {r[1]: r[2] for r in got}
    had = dict.fromkeys(sizes, 0)
    for t in range(1, first + 2):
        had[slots[t - 1]] += 1
        assert all(abs(w * t - had[s]) < 1 for s, w in weights.items())
    assert first > 500


def test_run_schedule_goes_on_after_sources_ran_out():
    weights = {"a": 0.9, "b": 0.05, None: 0.05, "z": 0}
    n_blocks = {"a": 500, "b": 1, None: 90, "z": 2}
    names, sources, blocks, slots = mixing.run_schedule(mixing.exact_quotas(weights), n_blocks)
    assert slots == sorted(set(slots)) and [names[k] for k in sources[-2:]] == ["z", "z"]
    for k, s in enumerate(names):
        assert [b for x, b in zip(sources, blocks) if x == k] == list(range(n_blocks[s]))
    assert all(abs(Fraction(0.9) / (Fraction(0.9) + 2 * Fraction(0.05)) * (t + 1) - b - 1) < 1 for k, b, t in zip(sources, blocks, slots) if names[k] == "a")


def test_more_than_20_000_sources(spark):
    df = spark.range(20_100).selectExpr("id doc_id", "concat('s', id) source")
    assert sorted(r.mix_rank for r in mixing.mix(df).select("mix_rank").collect()) == list(range(20_100))
