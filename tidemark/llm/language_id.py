"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its subwords, the byte n-grams of its lower-cased
letters, hashed into a table; a linear layer and a softmax follow. Both layers are trained by
stochastic gradient descent in numpy on a bounded sample of the labelled rows (SAMPLE_DOCS for
each language, SAMPLE_TOTAL for all, chosen by a hash of the id). At inference both layers are one table: a subword
adds a row of embedding times weights, so a text costs a lookup for each byte and order.

Scores are calibrated by a temperature, fitted on a fifth of the sample that training leaves
out, and a text whose calibrated score is under the threshold of that fifth's lowest percent is
flagged as rejected. A text that is null or has no letter is "und".

Defined cases: a null text and one without letters have the language "und", score 0, and are
rejected; with no labelled row at all every text is "und"; languages with one label share the
same path; very long texts are hashed whole, piece by piece; of languages that score the same the
first by name is taken; equal rows get equal results, and rows that repeat an id are judged each by
its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

BUCKETS = 1 << 15
DIM = 24
ORDERS = (2, 3, 4)
#: Documents of each language that training may see, about, and of all languages together.
SAMPLE_DOCS = 800
SAMPLE_TOTAL = 20_000
EPOCHS = 6
BATCH = 32
RATE = 4.0
REJECT_QUANTILE = 0.01
UNKNOWN = "und"

#: Bytes as the model sees them: ASCII letters lower-cased, other ASCII characters a space, the rest as they are.
_SEEN = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
#: Bytes hashed in one step: bounds the memory that a long text takes.
PIECE = 1 << 18


def subwords(raw: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's byte n-grams, piece by piece. Runs of non-letters count as one space."""
    seen = _SEEN[np.frombuffer(raw, np.uint8)]
    keep = np.ones(len(seen), bool)
    keep[1:] = (seen[1:] != 32) | (seen[:-1] != 32)
    x = np.concatenate([[32], seen[keep], [32]]).astype(np.uint8)
    for order in ORDERS:
        n = len(x) - order + 1
        for at in range(0, n, PIECE):
            size = min(PIECE, n - at)
            h = np.full(size, order, np.uint32)
            for k in range(order):
                h = (h ^ x[at + k : at + k + size]) * np.uint32(0x01000193)
            yield ((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int64)


def bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that a text has, and each one's share of its subwords."""
    counts = sum((np.bincount(at, minlength=BUCKETS) for at in subwords(raw)), np.zeros(BUCKETS, np.int64))
    at = np.flatnonzero(counts)
    return at, (counts[at] / max(1, counts.sum())).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Languages, the joint table (bucket x language), bias, temperature and the rejection threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0) -> None:
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.threshold = temperature, threshold

    def logits(self, raw: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for at in subwords(raw):
            total += self.table[at].sum(axis=0)
            n += len(at)
        return total / max(1, n) + self.bias

    def predict(self, raw: bytes) -> tuple[str, float]:
        p = softmax(self.logits(raw) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 0) -> Model:
    """Stochastic gradient descent on embeddings and weights; the last fifth of a fixed shuffle calibrates."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 20 else order
    rest = order[len(y) // 5 :] if len(y) >= 20 else order
    # Rare languages weigh as much as frequent ones.
    share = np.bincount(y, minlength=len(languages))
    weight = (len(y) / len(languages) / np.maximum(share, 1)).astype(np.float32)
    steps = EPOCHS * -(-len(rest) // BATCH)
    done = 0
    for _ in range(EPOCHS):
        for at in range(0, len(rest), BATCH):
            rate = RATE * (1 - done / max(1, steps))
            done += 1
            some = rest[at : at + BATCH]
            mean = np.stack([v @ emb[i] for i, v in (bags[k] for k in some)])
            p = softmax(mean @ w + bias)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[y[some]][:, None] / len(some)
            back = p @ w.T
            w -= rate * mean.T @ p
            bias -= rate * p.sum(axis=0)
            for k, g in zip(some, back):
                i, v = bags[k]
                emb[i] -= rate * len(some) * np.outer(v, g)
    model = Model(languages, emb @ w, bias)
    logits = np.stack([v @ model.table[i] + bias for i, v in (bags[k] for k in held)])
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean())
    model.threshold = float(np.quantile(softmax(logits / model.temperature).max(axis=1), REJECT_QUANTILE))
    return model


def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bags = [bag(t.as_py()) for t in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b[0].astype("<i2" if BUCKETS <= 1 << 15 else "<i4").tobytes() for b in bags], pa.binary()), pa.array([b[1].astype("<f4").tobytes() for b in bags], pa.binary())], names=["lang", "at", "share"])


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_total: int = SAMPLE_TOTAL) -> Model | None:
    """A model from rows (doc_id, text, lang), or None without a labelled text. Only bags of at most BUCKETS
    numbers come to the driver, for about sample_docs documents of each language, and about sample_total of all: with
    many languages each has an equal part of that."""
    rows = docs.where(F.col("lang").isNotNull() & text_or_empty().rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    sample_docs = min(sample_docs, max(1, sample_total // len(sizes)))
    # A share of each language by hash: as many rows at every size of the corpus, and no sort.
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share).select("lang", "text")
    got = sample.mapInArrow(_bag_batches, "lang string, at binary, share binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["at"]), bytes(r["share"])))
    bags = [(np.frombuffer(r["at"], "<i2").astype(np.int64), np.frombuffer(r["share"], "<f4")) for r in got]
    return train(bags, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    # The table has BUCKETS rows, a column for each language: a fixed size.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts:
            found = []
            for text in batch.column(1):
                text = text.as_py()
                found.append(m.predict(text.encode()) if any(map(str.isalpha, text)) else (UNKNOWN, 0.0))
            langs, scores = zip(*found) if found else ((), ())
            rejected = [x == UNKNOWN or s < m.threshold for x, s in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(batches, "doc_id long, lang_pred string, score double, rejected boolean")
