import hashlib
import itertools
import os
import random

import pytest

from tidemark.llm import sentencepiece_nbest as sp

pytestmark = pytest.mark.skipif(not os.path.exists(sp.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def vocab():
    with open(sp.MODEL, "rb") as f:
        return sp.Vocabulary(f.read(), 4)


def brute(vocab, text):
    """Every segmentation of text by the pieces (and unknown characters), scored."""
    shown = text.replace(sp.SPACE, "￿").replace(" ", sp.SPACE)
    out = []
    n = len(shown)
    for cuts in itertools.product([0, 1], repeat=n - 1):
        bounds = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
        total, ids = 0.0, []
        for a, b in zip(bounds, bounds[1:]):
            piece = shown[a:b]
            if piece in vocab.ids:
                total += vocab.scores[vocab.ids[piece]]
                ids.append(vocab.ids[piece])
            elif b - a == 1:
                total += vocab.unknown
                ids += [vocab.bytes[x] for x in text[a:b].encode()]
            else:
                break
        else:
            out.append((total, tuple(ids)))
    return sorted(out, key=lambda r: -r[0])


@pytest.mark.parametrize("text", ["a", "the cat", "hello  you", "été\nok", "x▁y", "日本 のz", "a b c d", "aaaaaaa", "  \n ", "😀 ok"])
def test_n_best_against_all_segmentations(vocab, text):
    want = brute(vocab, " " + text)
    got = vocab.n_best_chain(text)
    assert [s for s, _ in got] == [s for s, _ in want[:4]]
    by_ids = {ids: s for s, ids in want}
    assert all(by_ids[tuple(ids)] == s for s, ids in got)
    assert len({tuple(ids) for _, ids in got}) == len(got)
    whole = vocab.search(" " + text)
    assert [s for s, _ in whole] == [s for s, _ in got]
    assert all(vocab.decode(ids) == text for _, ids in got)


def test_links_side_by_side_as_one_by_one(vocab, monkeypatch):
    rng = random.Random(5)
    made = ["".join(rng.choices(" abcdethé日本▁😀\0.", k=rng.randint(1, 24))) for _ in range(3000)]
    texts = ["a", " ", "\n", "\0", "aaaaaaaa", " the", "😀", *made]
    monkeypatch.setattr(sp, "SIDE_BY_SIDE", 500)
    got = vocab.two_best_of_many(texts)
    assert vocab.two_best_of_many([]) == [] and sum(x is not None for x in got) > 500
    for text, x in zip(texts, got):
        if any(c != " " and (c == sp.SPACE or c not in vocab.ids) for c in text):
            assert x is None
        else:
            assert x == vocab.two_best(text)


def test_new_links_take_one_forward_pass(vocab, monkeypatch):
    texts = ["links which nobody had seen till now", "no  plain\n\n spaces \n", "nul\0 character", "", " a", "a "]
    want = [vocab.search(" " + t) if t else [(0.0, ())] for t in texts]
    with open(sp.MODEL, "rb") as f:
        fresh = sp.Vocabulary(f.read(), 4)
    single = []
    one_by_one = fresh.two_best
    monkeypatch.setattr(fresh, "two_best", lambda x: single.append(x) or one_by_one(x))
    monkeypatch.setattr(sp, "TOGETHER", 50)
    chains = list(fresh.chains(texts))
    assert set("".join(single)) <= set("\n\0nul ")  # only links with a character that has no piece
    for text, (links, got), expected in zip(texts, chains, want, strict=True):
        assert links == (fresh.links.findall(" " + text) if text else [])
        assert [score for score, _ in fresh.ranked_changes(links, got)] == [score for score, _ in expected]


def test_rows(spark):
    rows = [(0, "the cat sat\n\n on ▁ 😀"), (1, None), (2, ""), (3, " " * 50), (4, "ab " * 20000), (4, "ab " * 20000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    enc = sp.encode(df, alternatives=True).cache()
    got = enc.collect()
    assert len(got) == 6 and all(r.restored for r in got)
    back = {r.doc_id: r.text for r in sp.decode(enc).collect()}
    assert back == {d: t or "" for d, t in rows}
    assert all(len(r.n_best) == len(r.scores) and r.scores == sorted(r.scores, reverse=True) for r in got)
    assert sp.encode(df.limit(0)).count() == 0


def test_query_gives_all_n_best(spark, vocab, tmp_path):
    from tidemark.llm import queries

    rows = [(0, "the cat sat\n\n on ▁ 😀"), (1, None), (2, "aaaaaaa hello  you"), (3, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op3_sentencepiece(spark, str(tmp_path)).collect():
        want = vocab.n_best_chain(dict(rows)[r.doc_id] or "")
        assert r.scores == [s for s, _ in want] and r.n_best_pieces == [len(ids) for _, ids in want]
        assert r.n_best_sha256 == [hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() for _, ids in want]
        assert r.ids_sha256 == r.n_best_sha256[0] and r.n_pieces == r.n_best_pieces[0]
