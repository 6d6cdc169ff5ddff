import os

import corpus_pipeline as cp
import pytest

from tests.llm.test_exact_dedup import brute as copies
from tests.llm.test_quality_rules import plain as features
from tests.llm.test_simhash import least_reachable
from tests.llm.test_simhash import plain as fingerprint
from tidemark.llm import sentencepiece_nbest as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model file")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    base = " ".join(f"w{i}" for i in range(80))
    texts = [base, base.replace(" ", "\n"), base + " ", "too short", None, "", "again and again it says so " * 10]
    texts += [" ".join(f"x{i}_{k}" for k in range(40)) for i in range(6)]
    long = " ".join(f"y{k}" for k in range(900))
    texts += [long, long.replace("y450 ", "z450 "), "é ü ▁ 😀 " + " ".join(map(str, range(30)))]
    return [(i, t, "en", "hot" if i % 3 else f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]


def brute(docs):
    docs = [r for r in docs if not features(r[1])[-1]]
    kept = {d for d, keep, *_ in copies([r[:2] for r in docs]) if d == keep}
    docs = [r for r in docs if r[0] in kept]
    roots = least_reachable({r[0]: fingerprint(r[1]) for r in docs})
    return {r[0]: r[1] for r in docs if roots[r[0]] == r[0]}


def test_pipeline_against_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in cp.run(spark, str(tmp_path)).collect()}
    want = brute(rows())
    assert set(got) == set(want)
    with open(sp.MODEL, "rb") as f:
        vocab = sp.Vocabulary(f.read())
    for doc, text in want.items():
        score, ids = vocab.n_best_chain(text)[0]
        assert (got[doc].ids, got[doc].score, got[doc].n_pieces) == (ids, score, len(ids)) and vocab.decode(ids) == text


def test_stages(spark, tmp_path):
    assert [f.__name__ for _, f in cp.STAGES] == ["quality", "exact", "near", "mix", "encode"]
    docs = spark.createDataFrame(rows(), SCHEMA)
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def simulated(docs, key, block=16):
    """doc_id to its place in the mixture: slot by slot, the released block that is due first."""
    by = {}
    for d, s in docs:
        by.setdefault(s, []).append(d)
    for s in by:
        by[s].sort(key=lambda d: (key[d], d))
    weights = {s: round(len(by[s]) ** 0.5 * 1000) for s in by}
    total, had, out, t = sum(weights.values()), dict.fromkeys(by, 0), [], 0
    while len(out) < len(docs):
        open_ = [s for s in sorted(by) if had[s] * block < len(by[s]) and had[s] * total // weights[s] <= t]
        if open_:
            s = min(open_, key=lambda s: -(-(had[s] + 1) * total // weights[s]))
            out += by[s][had[s] * block : (had[s] + 1) * block]
            had[s] += 1
        t += 1
    return {d: k for k, d in enumerate(out)}


def test_the_mixture_is_in_the_result(spark, tmp_path):
    docs = [(i, " ".join(f"q{i}_{k}" for k in range(12)), "en", "hot" if i % 4 else f"s{i % 3}", 0) for i in range(260)]
    spark.createDataFrame(docs, SCHEMA).repartition(7).write.parquet(str(tmp_path / "documents.parquet"))
    key = {r.doc_id: r.k for r in spark.range(260).selectExpr("id doc_id", "xxhash64(id) k").collect()}
    got = {r.doc_id: r.mix_rank for r in cp.run(spark, str(tmp_path)).collect()}
    assert len(got) > 200 and sorted(got.values()) == list(range(len(got)))
    assert got == simulated([(d[0], d[3]) for d in docs if d[0] in got], key)
