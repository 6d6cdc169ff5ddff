import hashlib

import numpy as np
import pytest

from tidemark.llm import exact_dedup as ed


def plain(data):
    """The fingerprint digit by digit, from its definition."""
    data = data + b"\0" * (-len(data) % 4)
    h = 0
    for i in range(0, len(data), 4):
        h = (h * ed.BASE + int.from_bytes(data[i : i + 4], "big")) % ed.PRIME
    return h


def test_fingerprint_is_the_polynomial():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000, ed.CHUNK - 1, ed.CHUNK, ed.CHUNK + 1, 2 * ed.CHUNK + 7):
        data = bytes(rng.integers(0, 256, n, dtype=np.uint8))
        assert ed.fingerprint(data)[0] == plain(data)


def test_parts_combine():
    a, b = b"abcd" * 9, b"efghijk"
    whole = ed.fingerprint(a + b)
    assert ed.combine(ed.fingerprint(a), ed.fingerprint(b)) == whole
    assert ed.combine((0, 0), whole) == whole == ed.combine(whole, (0, 0))


@pytest.mark.parametrize("a,b,same", [("a b", "ab", True), ("", None, True), ("ab" * 70000, "ab " * 70000, True), ("ab" * 70000 + "c", "ab" * 70000 + "d", False), ("ab", "abc", False)])
def test_streaming_comparison(a, b, same):
    raw = [x if x is None else x.encode() for x in (a, b)]
    assert ed.equal_in_chunks(*raw) is same and ed.equal_in_chunks(*raw, chunk=3) is same


def brute(rows):
    by = {}
    for doc, text in rows:
        by.setdefault("".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r"), []).append((doc, text or ""))
    out = set()
    for norm, members in by.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0]))[0]
        out |= {(d, keep, len(members), d == keep, hashlib.sha256(norm.encode()).hexdigest()) for d, _ in members}
    return out


@pytest.mark.parametrize("huge", [ed.HUGE_CHARS, 5])
def test_against_brute_force(spark, huge):
    texts = [None, "", " \n", "one two", "onetwo", "one  two", "é ü", "éü", "other", "x" * 50, "x " * 50, "x" * 49 + "y", " " * 20, "日本語 テキスト" * 9, "日本語テキスト " * 9, "a b", "ab"]
    rows = [(i * 5 % 97, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, print int, keep_id string").repartition(3)
    got = ed.groups(df, huge)
    assert {tuple(r) for r in got.collect()} == brute(rows)
    kept = {r.doc_id for r in ed.deduplicate(df).collect()}
    assert kept == {d for d, k, *_ in brute(rows) if d == k}


def test_collisions_are_told_apart(spark, monkeypatch):
    """Texts whose fingerprints are equal although they differ are separated by their bytes."""
    rows = [(1, "aaaa"), (2, "bbbb"), (3, "a aaa"), (4, "bbbb"), (5, "cccc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    hashed = ed.fingerprints(df).withColumn("print", F.lit(7).cast("long"))
    monkeypatch.setattr(ed, "fingerprints", lambda docs, huge: hashed)
    got = {tuple(r) for r in ed.groups(df).collect()}
    assert got == brute(rows)


def test_repeated_and_empty(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert ed.groups(twice).count() == 3
    assert ed.groups(twice.limit(0)).count() == 0
