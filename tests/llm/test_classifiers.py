import numpy as np

from tidemark.llm import language_id as li
from tidemark.llm import toxicity as tx

EN = "the of and to in that was with for this which from they would there their been have were".split()
DE = "der die und das ist nicht mit sich auf für eine werden auch über können müssen schön größer".split()


def text(rng, words, n=60):
    return " ".join(rng.choice(words, n))


def test_language_of_held_out_texts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, text(rng, EN if i % 4 else DE), "en" if i % 4 else "de", "x") for i in range(240)]
    rows += [(900, None, None, "x"), (901, "", "en", "x"), (902, "123 !?", "en", "x"), (903, text(rng, EN), None, "x"), (904, "der und " * 200_000, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").cache()
    model = li.fit(df.where("doc_id < 160"))
    got = {r.doc_id: r for r in li.identify(df, model).collect()}
    assert all(got[i].lang_pred == rows[i][2] and got[i].score > 0.5 for i in range(160, 240))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (900, 901, 902))
    assert got[903].lang_pred == "en" and got[904].lang_pred == "de"


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert li.fit(df) is None and li.identify(df, None).first().lang_pred == "und"
    assert li.identify(df.limit(0), None).count() == 0
    one = spark.createDataFrame([(1, "the cat", "en")], "doc_id long, text string, lang string")
    assert li.identify(one, li.fit(one)).first().lang_pred == "en"


def test_pieces_don_t_change_a_bag(monkeypatch):
    raw = ("Größe und the cat, " * 50).encode()
    whole = li.bag(raw)
    monkeypatch.setattr(li, "PIECE", 37)
    parts = li.bag(raw)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = list(rng.choice(EN, 50))
        if toxic:
            for w in rng.choice(["zorgon", "idiot", "moron"], 3):
                words.insert(int(rng.integers(50)), str(w))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(900, None), (901, ""), (902, "you id10t! " * 30), (903, "the cat " * 100_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").cache()
    model = tx.fit(d, spark.createDataFrame(labels[:400] + [(901, None)], "doc_id long, toxic int"))
    assert "zorgon" in model.learned
    got = {r.doc_id: r.score for r in tx.score(d, model).collect()}
    assert all((got[i] >= tx.THRESHOLD) == (i % 5 == 0) for i in range(400, 600))
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs) and got[903] < tx.THRESHOLD


def test_toxicity_with_few_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in tx.score(d, tx.fit(d, none)).collect()} == {0.0}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in tx.score(d, tx.fit(d, one)).collect()} == {1.0}
    two = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert tx.score(d, tx.fit(d, two)).count() == 2 and tx.score(d.limit(0), tx.fit(d, two)).count() == 0


def test_isotonic_never_falls():
    rng = np.random.default_rng(2)
    p = rng.random(300)
    knots, values = tx.isotonic(p, (rng.random(300) < p).astype(float))
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()


def test_trees_learn_a_product():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    model = tx.Model()
    tx.grow(x[:1500], y[:1500], model)
    assert ((model.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


def plain_language(model, raw):
    """Logits by one subword at a time, from the joint table."""
    seen = [" " if b < 128 and not chr(b).isalpha() else chr(b).lower() if b < 128 else chr(b) for b in raw]
    x = [" "]
    for c in seen:
        if c != " " or x[-1] != " " or len(x) == 1:
            x.append(c)
    x = [ord(c) for c in [*x, " "]]
    rows = []
    for order in li.ORDERS:
        for at in range(len(x) - order + 1):
            h = order
            for b in x[at : at + order]:
                h = (h ^ b) * 0x01000193 % 2**32
            rows.append((h ^ h >> 15) % li.BUCKETS)
    logits = [sum(float(model.table[r][k]) for r in rows) / len(rows) + float(model.bias[k]) for k in range(len(model.languages))]
    e = [np.exp(v / model.temperature - max(logits) / model.temperature) for v in logits]
    k = max(range(len(e)), key=lambda i: (e[i], -i))
    return model.languages[k], e[k] / sum(e)


def test_language_against_a_plain_prediction(spark):
    rng = np.random.default_rng(5)
    rows = [(i, text(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(df)
    asked = [(100, text(rng, EN, 9)), (101, text(rng, DE, 9)), (102, "Über  the!! Straße"), (103, "a")]
    for r in li.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        lang, score = plain_language(model, dict(asked)[r.doc_id].encode())
        assert r.lang_pred == lang and abs(r.score - score) < 1e-5


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"word{i % 30} " * 5, f"l{i % 30}") for i in range(600)]
    assert len(li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_total=90).languages) > 15


def test_toxicity_against_a_plain_prediction(spark):
    rng = np.random.default_rng(7)
    docs = [(i, text(rng, EN, 30) + (" you moron!" if i % 3 == 0 else "")) for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = tx.fit(d, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int"))
    automaton = tx.Lexicon(model.learned).automaton()
    for r in tx.score(d, model).collect():
        x = tx.features(automaton, docs[r.doc_id][1])
        total = model.base
        for split, at, leaf in model.trees:
            node = 0
            while node < len(split):
                k = split[node]
                node = 2 * node + 1 + (sum(e < x[k] for e in model.edges[k]) > at[node])
            total += leaf[node - len(split)]
        p = 1 / (1 + np.exp(-total))
        knots, values = list(model.knots), list(model.values)
        j = next((j for j in range(1, len(knots)) if p < knots[j]), len(knots) - 1)
        want = values[j - 1] + (values[j] - values[j - 1]) * (p - knots[j - 1]) / (knots[j] - knots[j - 1]) if knots[j] > knots[j - 1] else values[j]
        assert abs(r.score - min(1, max(0, want))) < 1e-9
