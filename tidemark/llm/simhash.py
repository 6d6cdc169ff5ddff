"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits, each the majority over the 64-bit hashes of a text's word shingles.
Two fingerprints link at max_bits or fewer differing bits. Only distinct fingerprints are
indexed; copies share one. The index is dealt out by pigeonhole: of the four 16-bit blocks, two
at least must agree for two differing bits, so each of the six pairs of blocks is a bucket key.
Within a task, buckets hold their fingerprints in Gray rank order, in which those that share
leading masked bits stand together; upper nodes hold the shared bit pattern of a run of rows.
Pairs of nodes are compared from the top, their differences accumulate on the way down, and a
pair over the limit is pruned with all that lies below it.

Buckets that hold more than HOT_BUCKET fingerprints are dealt out again by the remaining bits:
a bucket then has 32 bits and about 11 more alike, so it holds at most the 2^22 fingerprints that
the other bits can make, however many documents there are. A task returns a spanning forest of its links, never all
pairs; the components are then found by star contraction.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links
like any other; very long texts are hashed whole, a block of shingles at a time; a bit set in just
half of the hashes is 0; equal rows have equal fingerprints and one component; rows that repeat an
id are linked each by its own text; rows without an id take their component's least id, null if
none has one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, rows_of, tag_of, text_or_empty
from tidemark.llm.components import components

#: The contract's shingle length, seed and limit.
WORDS = 3
SEED = 42
MAX_BITS = 2
#: Buckets with more distinct fingerprints are dealt out again.
HOT_BUCKET = 20_000
#: Node pairs compared in one vectorised step: bounds a task's memory.
STEP_PAIRS = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | bytes | None, words: int = WORDS, seed: int = SEED) -> int:
    raw = text.encode() if isinstance(text, str) else text or b""
    parts = raw.translate(_LOWER).split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = list(map(b" ".join, zip(*[parts[k:] for k in range(words)])))
    n, counts = len(shingles), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        hashes = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles[at : at + (1 << 16)]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        prints = np.array([simhash(t.as_py()) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], names=["doc_id", "tag", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, tag (of its text) and print (the 64 bits as a signed long) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), tag_of().alias("tag"))
    return rows.mapInArrow(_hash_batches, "doc_id long, tag long, print long")


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Place of each pattern in the Gray code sequence: the running parity of its bits from the top."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [start, end): the number of the range and the value, for each value in each."""
    sizes = ends - starts
    which = np.repeat(np.arange(len(starts)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[which]


def linked_pairs(buckets: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (i < j) in one bucket at max_bits or fewer differing bits.

    Rows must be sorted by (bucket, Gray rank) and be distinct within a bucket. Level d of the
    index has a node for each run of rows that share the bucket and the top 8 * d bits.
    """
    n = len(prints)
    if n < 2:
        return
    at_level = []
    for depth in range(9):
        top = prints >> np.uint64(64 - 8 * depth) if depth else np.zeros(n, np.uint64)
        new = np.ones(n, bool)
        new[1:] = (buckets[1:] != buckets[:-1]) | (top[1:] != top[:-1])
        at_level.append(np.append(np.flatnonzero(new), n))
    roots = at_level[0]
    many = np.flatnonzero(np.diff(roots) > 1)
    # Depth first over blocks of node pairs: the stack holds (depth, left node, right node, bits so far).
    stack = [(0, many, many, np.zeros(len(many), np.int64))]
    while stack:
        depth, left, right, bits = stack.pop()
        if depth == 8:
            yield at_level[8][left], at_level[8][right]
            continue
        bounds, below = at_level[depth], at_level[depth + 1]
        first, last = np.searchsorted(below, bounds[:-1]), np.searchsorted(below, bounds[1:])
        fan = (last - first)[left] * (last - first)[right]
        if len(left) > 1 and fan.sum() > STEP_PAIRS:
            half = len(left) // 2
            stack += [(depth, left[half:], right[half:], bits[half:]), (depth, left[:half], right[:half], bits[:half])]
            continue
        pair, child = _spans(first[left], last[left])
        again, other = _spans(first[right[pair]], last[right[pair]])
        pair, child = pair[again], child[again]
        ok = (left[pair] != right[pair]) | (child <= other)
        pair, child, other = pair[ok], child[ok], other[ok]
        mask = np.uint64(0xFF << (56 - 8 * depth))
        more = np.bitwise_count((prints[below[child]] ^ prints[below[other]]) & mask).astype(np.int64)
        total = bits[pair] + more
        ok = total <= max_bits
        if depth == 7:
            ok &= child != other
        if ok.any():
            stack.append((depth + 1, child[ok], other[ok], total[ok]))


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row that the pairs connect it with."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by bucket; a bucket that goes on in the next batch is carried over."""
    held: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = rows.bucket.iat[-1] if len(rows) else None
        done, held = rows[rows.bucket != last], rows[rows.bucket == last]
        yield _links(done)
    if held is not None:
        yield _links(held)


def _links(rows: pd.DataFrame) -> pd.DataFrame:
    prints = rows.print.to_numpy().view(np.uint64)
    buckets, ids = rows.bucket.to_numpy(), rows.id.to_numpy()
    order = np.lexsort((gray_rank(prints), buckets))
    prints, buckets, ids = prints[order], buckets[order], ids[order]
    root = spanning(len(prints), linked_pairs(buckets, prints))
    linked = root != np.arange(len(root))
    return pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})


def _buckets(distinct: DataFrame) -> DataFrame:
    """(bucket, id, print): a row for each pair of 16-bit blocks. A bucket is a hash of the pair's place and bits."""
    masks = [(0xFFFF << 16 * i) | (0xFFFF << 16 * j) for i, j in combinations(range(4), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(signed)])
    keyed = distinct.select("id", "print", F.explode(keys).alias("key"))
    return keyed.select(F.xxhash64("key.k", "key.bits").alias("bucket"), F.col("key.k").alias("k"), "id", "print")


def _split_hot(keyed: DataFrame, hot_bucket: int) -> DataFrame:
    """Deals buckets over the limit out by the 32 bits that they leave open, cut in three: two differing bits
    leave one third alike. Each bucket is judged by its own size, so most rows stay as they are."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sized = keyed.join(sizes, "bucket")
    thirds = []
    for k, (i, j) in enumerate(combinations(range(4), 2)):
        open_bits = [16 * b + x for b in range(4) if b not in (i, j) for x in range(16)]
        parts = []
        for part in (open_bits[:11], open_bits[11:22], open_bits[22:]):
            mask = sum(1 << x for x in part)
            parts.append(F.col("print").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
        thirds.append((k, F.array(*[F.xxhash64("bucket", F.lit(t), part) for t, part in enumerate(parts)])))
    choice = F.when(F.col("n") <= hot_bucket, F.array("bucket"))
    for k, buckets in thirds:
        choice = choice.when(F.col("k") == k, buckets)
    return sized.select(F.explode(choice).alias("bucket"), "id", "print")


def links(distinct: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Edges (a, b) between ids (of any kind) of distinct fingerprints (id, print): enough to connect all that link."""
    keyed = _split_hot(_buckets(distinct), hot_bucket)
    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInPandas(_link_batches, "a long, b long")


def near_groups(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (the least doc_id it connects to)."""
    return tagged_groups(docs, hot_bucket).drop("tag")


def tagged_groups(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """As near_groups(), with the tag of the text that a row is about. Fingerprints are what links, so they name the
    nodes; a component's id is the least of its documents'."""
    hashed = cut(fingerprints(docs))
    distinct = cut(hashed.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select(F.col("print").alias("id"), "print"), hot_bucket))
    # Only fingerprints that link have a component.
    joined = distinct.join(found, F.col("print") == F.col("id"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "of_component")
    named = joined.join(least, F.col("component") == F.col("of_component")).select(F.col("id").alias("of_print"), "component_id")
    ids = distinct.join(named, F.col("print") == F.col("of_print"), "left").select(F.col("print").alias("of_print"), F.coalesce("component_id", "least").alias("component_id"))
    return hashed.join(ids, F.col("print") == F.col("of_print")).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "tag")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component those with the least doc_id (one, unless rows repeat it)."""
    kept = tagged_groups(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows_of(docs, kept.select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag")))
