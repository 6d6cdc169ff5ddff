"""Rows that repeat an id with another text, rows that repeat it with its text, and rows without an id."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import exact_dedup, mixing, pipeline, quality_rules, repeats, simhash


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 0) for r in rows], "doc_id long, text string, source string, kept int").repartition(3)


def long(seed, n=700):
    return bytes(np.random.default_rng(seed).integers(97, 123, n, dtype=np.uint8)).decode()


@pytest.mark.parametrize("huge", [1 << 22, 2])
def test_exact(spark, huge):
    rows = [(1, "aaa"), (1, "bbb"), (2, "aaa"), (3, "a a a"), (1, "bbb"), (None, "ccc"), (4, "c cc"), (None, "ddd")]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs(spark, rows), huge).collect())
    assert got == Counter([(1, 3, 3, False), (2, 3, 3, False), (3, 3, 3, True), (1, 1, 2, True), (1, 1, 2, True), (None, 4, 2, False), (4, 4, 2, True), (None, None, 1, True)])
    kept = Counter((r.doc_id, r.text) for r in exact_dedup.deduplicate(docs(spark, rows)).collect())
    assert kept == Counter([(3, "a a a"), (1, "bbb"), (1, "bbb"), (4, "c cc"), (None, "ddd")])


def test_simhash(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(60)) for c in "xyz")
    rows = [(1, x), (1, y), (0, x), (2, y), (2, z), (2, z), (None, z + " more"), (None, "alone here and now")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(docs(spark, rows)).collect()}
    f = lambda t: f"{simhash.simhash(t):016x}"
    assert got[1, f(x)] == got[0, f(x)] == 0 and got[1, f(y)] == got[2, f(y)] == 1 and got[2, f(z)] == 2 and got[None, f("alone here and now")] is None
    kept = {(r.doc_id, r.text) for r in simhash.deduplicate(docs(spark, rows)).collect()}
    assert {(0, x), (1, y), (2, z), (None, "alone here and now")} <= kept and not {(1, x), (2, y)} & kept


def test_repeats(spark):
    x, y = long(1), long(2)
    rows = [(1, x), (2, x), (1, y), (3, long(3)), (3, long(3)), (None, long(4)), (None, long(5) + x)]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs(spark, rows)).collect())
    assert got == Counter([(1, 700, 700, 1), (2, 700, 700, 1), (1, 700, 0, 0), (3, 700, 700, 1), (3, 700, 700, 1), (None, 700, 0, 0), (None, 1400, 700, 1)])


def test_quality_and_stages(spark):
    good = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(1, good("a")), (1, "bad"), (2, good("b")), (None, good("c")), (None, None), (3, good("d")), (3, good("e"))]
    kept = Counter((r.doc_id, r.text) for r in quality_rules.passing(docs(spark, rows)).collect())
    assert kept == Counter([(1, good("a")), (2, good("b")), (None, good("c")), (3, good("d")), (3, good("e"))])
    assert mixing.ordered(docs(spark, rows)).count() == len(rows)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs(spark, rows), "").count() > 0
