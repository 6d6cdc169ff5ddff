import hashlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import repeats


def brute(texts, length):
    """Covered bytes of each text: every window is looked up among all windows."""
    places = {}
    for k, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            places.setdefault(t[s : s + length], []).append((k, s))
    covered = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for k, s in where:
                covered[k][s : s + length] = True
    return covered


def corpus(rng):
    random = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8))
    passage, other = random(1000), random(450)
    docs = [None, "", "short", "x" * 399, "y" * 1000]
    docs += [(random(int(rng.integers(0, 300))) + passage + random(int(rng.integers(0, 300)))).decode() for _ in range(12)]
    docs += [(random(100) + other + random(50)).decode(), (random(7) + other).decode()]
    base = bytearray(random(3000))
    for _ in range(8):
        base[int(rng.integers(3000))] = 65
        docs.append(base.decode())
    docs += ["é" * 10 + passage[100:550].decode() + "ü", passage[:399].decode(), passage[:401].decode(), "ab" * 500]
    docs += [random(2000).decode()] * 3
    part = random(500).decode()
    docs.append(part + random(100).decode() + part)
    docs += [random(800).decode() for _ in range(5)]
    return docs


@pytest.mark.parametrize("piece", [1 << 19, 700])
def test_runs_hold_every_window_once(monkeypatch, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    rng = np.random.default_rng(3)
    docs = {1: bytes(rng.integers(97, 123, 5000, dtype=np.uint8)), 2: b"x" * 399, 3: b"ab" * 600, 4: b"", 5: bytes(rng.integers(97, 99, 1200, dtype=np.uint8))}
    batch = pa.RecordBatch.from_arrays([pa.array(list(docs), pa.int64()), pa.array([d.decode() for d in docs.values()]), pa.array([7] * len(docs), pa.int64())], names=["id", "text", "tag"])
    seen = {d: [] for d in docs}
    grams: dict = {}
    for out in repeats._anchor_batches(iter([batch])):
        for r in out.to_pylist():
            data, first, last = docs[r["id"]], r["at"] - r["before"], r["at"] + r["behind"] - repeats.LENGTH
            seen[r["id"]] += range(first, last + 1)
            assert first <= r["at"] and r["at"] + repeats.GRAM <= first + repeats.LENGTH
            assert grams.setdefault(r["h"], data[r["at"] : r["at"] + repeats.GRAM]) == data[r["at"] : r["at"] + repeats.GRAM]
    assert all(sorted(w) == list(range(max(0, len(docs[d]) - repeats.LENGTH + 1))) for d, w in seen.items())


@pytest.mark.parametrize("hot", [2_000, 1])
def test_against_all_windows(spark, hot):
    docs = corpus(np.random.default_rng(11))
    rows = [(i * 7, t, 1) for i, t in enumerate(docs)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, at int").repartition(3), hot).collect()}
    raw = [(t or "").encode() for t in docs]
    assert len(got) == len(docs)
    for (doc, _, _), data, covered in zip(rows, raw, brute(raw, repeats.LENGTH)):
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        edges = np.diff(np.concatenate([[0], covered.astype(int), [0]]))
        r = got[doc]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), int(covered.sum()), int((edges == 1).sum()))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest() and bytes(r.kept) == kept


def test_parts_of_runs_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        anchor, length = b"ANCHOR", 12
        runs = [(bytes(rng.integers(97, 99, int(rng.integers(0, 9)), dtype=np.uint8)), bytes(rng.integers(97, 99, int(rng.integers(0, 9)), dtype=np.uint8))) for _ in range(int(rng.integers(2, 12)))]
        runs = list(dict.fromkeys(runs))
        got = repeats.repeated_parts([(a + anchor + b, len(a)) for a, b in runs], length)
        for i, (a, b) in enumerate(runs):
            want = set()
            for j, (c, d) in enumerate(runs):
                if i != j:
                    back = next((k for k in range(min(len(a), len(c))) if a[-1 - k] != c[-1 - k]), min(len(a), len(c)))
                    ahead = next((k for k in range(min(len(b), len(d))) if b[k] != d[k]), min(len(b), len(d))) + len(anchor)
                    if back + ahead >= length:
                        want |= set(range(len(a) - back, len(a) + ahead))
            assert {x for p, q in got[i] for x in range(p, q)} == want


def test_empty(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
