"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (plain and with disguises undone), hits near
second-person words, capitals, punctuation, and obfuscation rates. The lexicon is a short list
of insults, widened by words that one half of the training sample uses in toxic documents far
more than elsewhere. The trees (logistic loss, histogram splits) are grown in numpy on the other
half, and a fifth of that, kept out of the trees, fits the isotonic calibration.

The sample is bounded: about SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents, chosen by a hash
of the id. Every document is scored as a whole.

Defined cases: a null text counts as empty and is scored like any other; documents without a
label are only scored; labels that are null are not learned from; a document with several
labels counts once for each; very long texts are scanned whole, in linear time; words that tie for
the lexicon go by name; rows that repeat an id are scored each by its own text, and all of them
learned from under the id's label; without any label, or with one class only, every score is that class's share
(0 without labels); equal rows get equal scores; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, text_or_empty

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
LEARNED_WORDS = 200
#: Toxic documents that must have a word before it is learned, at least.
LEAST_DOCS = 4
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.1, 32, 8
THRESHOLD = 0.3

#: Insults that the lexicon starts from.
INSULTS = (
    "idiot stupid moron loser trash scum clown pathetic disgusting worthless dumb fool jerk imbecile filth garbage vermin ugly "
    "hate kill bastard crap damn shut imbécile connard crétin ordure stupide idiota estúpido imbécil basura dummkopf trottel abschaum"
).split()
#: Second-person words.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein ihr euch tu te toi vous votre ton tes usted tus vosotros".split()
#: Characters that stand for letters in disguised words.
DISGUISES = {"@": "a", "4": "a", "3": "e", "1": "i", "!": "i", "0": "o", "$": "s", "5": "s", "7": "t"}

NEAR_CHARS = 40
_EDGE = "[\\x20\\x09-\\x0D.,;:!?\"'()\\[\\]|#*$%&]+"

_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(256) if 97 <= b <= 122 or b >= 128]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:\"'()-[]/"]] = 4
_KIND[ord("!")] = 5
_KIND[ord("?")] = 6
_KIND[[ord(c) for c in "*@$#%&|<>~^_=+"]] = 7
_KIND[[9, 10, 11, 12, 13, 32]] = 8
FEATURES = 16


class Lexicon:
    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        weights = {w: 1.0 for w in INSULTS} | self.learned
        for word, weight in weights.items():
            found.add_word(word, (len(word), weight, word in self.learned))
        for word in SECOND_PERSON:
            if word not in weights:
                found.add_word(word, (len(word), None, False))
        found.make_automaton()
        return found


def _scan(automaton, text: str) -> tuple[list[tuple[int, float, bool]], list[int]]:
    """Whole-word lexicon hits (place, weight, learned) and second-person places of a lower-cased text."""
    hits, persons, n = [], [], len(text)
    for end, (size, weight, learned) in automaton.iter(text):
        start = end - size + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < n and text[end + 1].isalnum()):
            continue
        if weight is None:
            persons.append(start)
        else:
            hits.append((start, weight, learned))
    return hits, persons


_UNDO = str.maketrans(DISGUISES | {"*": None, "_": None})


def features(automaton, text: str) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = _KIND[raw]
    count = np.bincount(kinds, minlength=9)
    n_chars = max(1, len(raw))
    letters = max(1, int(count[1] + count[2]))
    space = kinds == 8
    n_words = int((~space[:1]).sum() + (space[:-1] & ~space[1:]).sum())
    words = max(1, n_words)
    caps = kinds == 2
    shouted = int((caps[:-2] & caps[1:-1] & caps[2:]).sum())
    drawn = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (kinds[2:] < 3) & (kinds[2:] > 0)).sum())
    letter = (kinds == 1) | caps
    odd = (kinds == 3) | (kinds == 7) | (kinds == 5)
    disguised = int((letter[:-2] & odd[1:-1] & letter[2:]).sum())
    lower = text.lower()
    hits, persons = _scan(automaton, lower)
    more = 0
    if count[3] or count[5] or count[7]:
        more = max(0, len(_scan(automaton, lower.translate(_UNDO))[0]) - len(hits))
    near = 0
    if hits and persons:
        places, at = np.sort(persons), np.array([h[0] for h in hits])
        near = int((np.searchsorted(places, at + NEAR_CHARS, "right") > np.searchsorted(places, at - NEAR_CHARS, "left")).sum())
    weights = [w for _, w, _ in hits]
    return [
        len(hits) / words,
        np.log1p(len(hits)),
        sum(weights) / words,
        max(weights, default=0.0),
        sum(1 for h in hits if h[2]) / words,
        more / words,
        near / words,
        len(persons) / words,
        count[2] / letters,
        shouted / letters,
        count[5] / n_chars,
        count[6] / n_chars,
        (count[4] + count[5] + count[6] + count[7]) / n_chars,
        disguised / words,
        drawn / letters,
        np.log1p(n_words),
    ]


# ---- trees -------------------------------------------------------------------------------------


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    #: Each tree: split features and bins by node (heap order), and leaf values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0
    knots: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    values: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    learned: dict[str, float] = field(default_factory=dict)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees, before calibration."""
        binned = self.binned(x)
        total = np.full(len(x), self.base)
        for split, at, leaf in self.trees:
            total += leaf[_leaves(binned, split, at)]
        return total

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(1 / (1 + np.exp(-self.raw(x))), self.knots, self.values), 0.0, 1.0)


def _leaves(binned: np.ndarray, split: np.ndarray, at: np.ndarray) -> np.ndarray:
    node = np.zeros(len(binned), np.int64)
    rows = np.arange(len(binned))
    for _ in range(DEPTH):
        node = 2 * node + 1 + (binned[rows, split[node]] > at[node])
    return node - (2**DEPTH - 1)


def grow(x: np.ndarray, y: np.ndarray, model: Model) -> None:
    """Adds trees to the model: each one fits the gradient of the logistic loss, level by level, over histograms."""
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    model.base = float(np.log(share / (1 - share)))
    binned = model.binned(x)
    total = np.full(len(y), model.base)
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        split, at = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for k in range(x.shape[1]):
                cell = (node - first) * (BINS + 1) + binned[:, k]
                sums = [np.bincount(cell, w, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1) for w in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                where = gain.argmax(axis=1)
                top = gain[np.arange(width), where]
                better = np.flatnonzero(top > best)
                best[better], split[first + better], at[first + better] = top[better], k, where[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), split[node]] > at[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        model.trees.append((split, at, value))
        total += value[leaf]


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on p: neighbouring blocks pool while they fall.

    A block's value is its mean with half a count of either class, which keeps 0 and 1 apart from
    what few rows can show; between the blocks' centres the fit is linear.
    """
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, sum of p
    for a, b in zip(p[order], y[order]):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    knots = np.array([b[2] / b[1] for b in blocks])
    values = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1) for b in blocks]))
    return np.concatenate([[0.0], knots, [1.0]]), np.concatenate([[values[0] / 2], values, [(1 + values[-1]) / 2]])


# ---- fitting and scoring -----------------------------------------------------------------------


def _feature_batches(learned: dict[str, float]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(learned).automaton()
        for batch in parts:
            rows = [np.asarray(features(automaton, t.as_py()), np.float64).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["toxic", "x"])

    return batches


def _learn_words(half: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words whose share of toxic documents is far over their share of the others, by log odds."""
    words = F.array_distinct(F.split(F.lower("text"), _EDGE))
    seen = half.select("toxic", F.explode(words).alias("word")).where(F.length("word") > 1)
    counts = seen.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    scored = counts.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds)
    # Two standard errors below its log odds a word must still be six times as frequent.
    sure = scored.withColumn("least", F.col("odds") - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    top = sure.where(F.col("least") > float(np.log(6))).orderBy(F.desc("least"), "word").limit(LEARNED_WORDS).collect()
    return {r["word"]: float(r["odds"]) for r in top}


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic)."""
    marks = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("mark_id"), (F.col("toxic") != 0).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        share = float(next(iter(sizes), 0))
        return Model(values=np.array([share, share]))
    draw = F.pmod(F.xxhash64("mark_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample_toxic / sizes[1]))).otherwise(F.lit(min(1.0, sample_clean / sizes[0])))
    sample = cut(marks.where(draw < share))
    if sample.count() > 2 * (sample_toxic + sample_clean):
        raise ValueError("the sample is over its bound")
    # As many ids as the parameters allow, at every size of the corpus: texts stay where they are.
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("mark_id")).select("toxic", text_or_empty().alias("text"), F.pmod(F.xxhash64("mark_id", F.lit(7)), F.lit(2)).alias("half")))
    first = rows.where("half = 0")
    n = {r["toxic"]: r["n"] for r in first.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = _learn_words(first, n.get(1, 0), n.get(0, 0))
    got = rows.where("half = 1").select("toxic", "text").mapInArrow(_feature_batches(learned), "toxic int, x binary").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["toxic"]))
    model = Model(learned=learned)
    if len({r["toxic"] for r in got}) < 2:
        model.values = np.full(2, sizes[1] / sum(sizes.values()))
        return model
    x = np.array([np.frombuffer(r["x"]) for r in got])
    y = np.array([r["toxic"] for r in got], float)
    order = np.random.default_rng(0).permutation(len(y))
    held, rest = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[held])) < 2 or len(set(y[rest])) < 2:
        held = rest = order
    grow(x[rest], y[rest], model)
    # The sample holds more toxic rows than the corpus: rows count for what they stand for.
    p, again = 1 / (1 + np.exp(-model.raw(x[held]))), y[held]
    model.knots, model.values = isotonic(p, again)
    odds = (sizes[1] / sizes[0]) / (max(1.0, y.sum()) / max(1.0, len(y) - y.sum()))
    model.values = model.values * odds / (model.values * odds + 1 - model.values)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score."""
    # A fixed number of trees and at most LEARNED_WORDS words.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        automaton = Lexicon(m.learned).automaton()
        for batch in parts:
            if batch.num_rows:
                x = np.array([features(automaton, t.as_py()) for t in batch.column(1)], float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.score(x))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, "doc_id long, score double")
