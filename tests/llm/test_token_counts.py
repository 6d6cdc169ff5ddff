import os

import numpy as np
import pytest

from tidemark.llm import token_counts as tc

pytestmark = pytest.mark.skipif(not os.path.exists(tc.RANKS), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    with open(tc.RANKS, "rb") as f:
        return tc.Encoder(f.read())


def brute(ends, sections, rule):
    """Each token looked at byte by byte."""
    counts, outside = [0.0] * len(sections), 0.0
    owner = {b: k for k, (s, e) in enumerate(sections) for b in range(s, e)}
    for start, end in zip([0, *ends[:-1]], ends):
        of = [owner.get(b) for b in range(start, end)]
        if rule == "share":
            for k in of:
                if k is None:
                    outside += 1 / len(of)
                else:
                    counts[k] += 1 / len(of)
            continue
        if rule == "first":
            k = of[0]
        else:
            sizes = [(of.count(k), -k) for k in set(of) - {None}]
            k = -max(sizes)[1] if sizes and max(sizes)[0] >= of.count(None) else None
        if k is None:
            outside += 1
        else:
            counts[k] += 1
    return counts, outside


@pytest.mark.parametrize("rule", tc.RULES)
def test_against_bytes(encoder, rule):
    rng = np.random.default_rng(0)
    for text in ["the cat\n\nsat on\nthe  mats", "été 日本語\n😀 ok", "a", "\n\n\n", "word" * 30]:
        raw = text.encode()
        ids, ends = encoder.ends(text)
        assert ends[-1] == len(raw) and encoder.encoding.decode(ids.tolist()) == text
        for _ in range(20):
            cuts = np.unique(rng.integers(0, len(raw) + 1, 6))
            spans = [(int(a), int(b)) for a, b in zip(cuts[::2], cuts[1::2])]
            if not spans:
                continue
            counts, outside, _ = tc.attribute(ends, np.array(spans), rule)
            want, missing = brute(ends.tolist(), spans, rule)
            assert counts.tolist() == pytest.approx(want) and outside[0] == pytest.approx(missing)


def test_rows(spark, encoder):
    texts = {1: "one two\nthree\n", 2: None, 3: "", 4: "x y\n" * 20_000}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()] + [(1, texts[1], 1)], "doc_id long, text string, section int")
    got = tc.count(df).collect()
    for doc, t in texts.items():
        rows = [r for r in got if r.doc_id == doc]
        total = len(encoder.ends(t or "")[0])
        assert sum(r.n_tokens for r in rows) == total * (2 if doc == 1 else 1) and {r.doc_tokens for r in rows} == {total}
    assert tc.count(df.limit(0)).count() == 0
    given = spark.createDataFrame([(1, "one two three", [(0, 3), (8, 13)])], "doc_id long, text string, parts array<struct<start:int,end:int>>")
    assert {r.section: r.n_tokens for r in tc.count(given, sections="parts").collect()} == {0: 1, 1: 1, -1: 1}
