"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Tokens of a byte-level vocabulary are consecutive
spans of the text's UTF-8 bytes, so the running sum of their lengths maps every token to its
place; sections (lines, or any given spans) are intervals over the same bytes. Both lists are
sorted, and an interval join by binary search attributes tokens to sections.

A token over a boundary goes by an explicit rule: "first" to the section of its first byte,
"most" to the section with most of its bytes (the earlier one in a tie), "share" to all that it
touches in proportion to bytes. Tokens outside of all sections count for section -1. Under every
rule the counts sum to the document's tokens.

Defined cases: a null or empty text has no tokens and one empty line section; empty sections get
no token; very long texts are encoded whole; a tie under "most" goes to the earlier section; rows
that repeat an id are counted each by its own text; equal rows get equal rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenization pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("first", "most", "share")


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of a whole text, and the byte at which each one ends."""
        ids = np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)
        return ids, np.cumsum(self.lengths[ids])


_LOADED: dict[bytes, Encoder] = {}


def encoder(ranks: bytes) -> Encoder:
    key = hashlib.sha256(ranks).digest()
    if key not in _LOADED:
        _LOADED[key] = Encoder(ranks)
    return _LOADED[key]


def lines(raw: bytes) -> np.ndarray:
    """Sections of a text: [start, end) in bytes of each line, its line break included."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    bounds = np.unique(np.concatenate([[0], breaks, [len(raw)]]))
    if len(bounds) == 1:
        return np.zeros((1, 2), np.int64)
    return np.stack([bounds[:-1], bounds[1:]], axis=1)


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section, tokens outside, and boundary-crossing tokens of each section's end.

    sections: sorted, disjoint [start, end). The counts are floats under "share", else whole.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    starts = np.concatenate([[0], ends[:-1]])
    n = len(sections)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    # First and last section that a token may touch: sections that end after its start and begin before its end.
    first = np.searchsorted(sections[:, 1], starts, side="right")
    last = np.searchsorted(sections[:, 0], ends, side="left") - 1
    touched = np.maximum(last - first + 1, 0)
    inside = (touched == 1) & (sections[np.minimum(first, n - 1), 0] <= starts) & (ends <= sections[np.minimum(first, n - 1), 1])
    counts += np.bincount(first[inside], minlength=n)[:n]
    outside = float((touched == 0).sum())
    for t in np.flatnonzero((touched > 0) & ~inside):
        k = np.arange(first[t], last[t] + 1)
        overlap = np.minimum(sections[k, 1], ends[t]) - np.maximum(sections[k, 0], starts[t])
        missing = ends[t] - starts[t] - overlap.sum()
        crossing[k[0]] += 1
        if rule == "share":
            counts[k] += overlap / (ends[t] - starts[t])
            outside += missing / (ends[t] - starts[t])
        elif rule == "most":
            best = int(np.argmax(overlap))
            if missing > overlap[best]:
                outside += 1
            else:
                counts[k[best]] += 1
        elif sections[k[0], 0] <= starts[t]:
            counts[k[0]] += 1
        else:
            outside += 1
    return counts, np.array([outside]), crossing


COUNTED = "doc_id long, section int, start_byte long, end_byte long, n_tokens double, n_crossing long, doc_tokens long"


def count(docs: DataFrame, path: str = RANKS, rule: str = "most", sections: str | None = None) -> DataFrame:
    """One row per section of each document (by default its lines), with its tokens.

    sections: name of a column of array<struct<start,end>> in bytes, sorted and disjoint, in place of lines.
    """
    with open(path, "rb") as file:  # a vocabulary of a fixed size, under one megabyte
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(ranks.value)
        for batch in rows:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                out: list[list[np.ndarray]] = [[] for _ in range(7)]
                for row, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    _, ends = e.ends(text)
                    if sections is None:
                        spans = lines(text.encode())
                    else:
                        spans = np.array([(s["start"], s["end"]) for s in part.column(2)[row].as_py() or ()], np.int64).reshape(-1, 2)
                    numbers = np.arange(len(spans))
                    if len(spans):
                        counts, outside, crossing = attribute(ends, spans, rule)
                    else:
                        counts, outside, crossing = np.zeros(0), np.array([float(len(ends))]), np.zeros(0, np.int64)
                    if outside[0]:
                        numbers, spans = np.append(numbers, -1), np.concatenate([spans, [[-1, -1]]])
                        counts, crossing = np.append(counts, outside), np.append(crossing, 0)
                    n = len(numbers)
                    for column, value in zip(out, (np.full(n, doc), numbers, spans[:, 0], spans[:, 1], counts, crossing, np.full(n, len(ends)))):
                        column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(out, kinds)], names=COUNTED.replace(",", "").split()[::2])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *([F.col(sections)] if sections else []))
    return rows.mapInArrow(batches, COUNTED)
