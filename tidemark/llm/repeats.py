"""Repeated byte strings across a corpus, by hash-compared suffix sorting.

Every string of LENGTH bytes that starts in two places is removed wherever it stands. Suffixes
that can't match are never sorted: each window of LENGTH bytes names one anchor, the GRAM-byte
string in it whose polynomial hash is least, so equal windows name equal anchors. A run of
windows with the same anchor is one row: the anchor's hash and a digest of the run's bytes.

1. Runs that are equal as a whole (same anchor, same 128-bit digest) are repeated as a whole.
   They are counted by a grouped aggregate, so thousands of copies cost a row for each task.
2. The other runs of an anchor that has several different ones are sorted in the order of the
   suffixes that begin at the anchor, and again in that of the prefixes read backward. Two
   suffixes are compared by their longest common extension: a binary search over prefix
   polynomial hashes, verified on the bytes, within a mergesort. Neighbours are then joined in
   descending order of their common extension to the right, smaller sets into larger, and each
   run meets its neighbours in the backward order: that gives all maximal pairs of extensions
   that a run has with any other, without looking at all pairs.
3. Anchors with more than HOT_RUNS different runs are settled without bringing them together: a
   digest of each of their windows is counted by a grouped aggregate.

Defined cases: a null text counts as empty; texts under LENGTH bytes have no match; overlapping
occurrences count, so a long run of one byte is removed; very long texts are cut into pieces that
overlap, so that each window is in one; two rows with one id are two places, and each is reported
on its own text; a null id is an id like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import NO_ID, id_of, stored, tag_of, text_or_empty

LENGTH = 400
GRAM = 200
#: Windows of a piece: longer documents are taken in pieces that overlap.
PIECE = 1 << 19
#: Anchors with more different runs than this are settled window by window.
HOT_RUNS = 2_000

_X = 0x9E3779B97F4A7C15 | 1
_X_INVERSE = pow(_X, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        both = []
        for base in (_X, _X_INVERSE):
            out = np.ones(size, np.uint64)
            filled = 1
            while filled < size:
                with np.errstate(over="ignore"):
                    out[filled : 2 * filled] = out[:filled] * np.uint64(pow(base, filled, 1 << 64))
                filled *= 2
            both.append(out)
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of every prefix, the empty one first: sums of byte times power, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window of the given width, from running minima within blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor place, first and last window) of each run in texts laid end to end.

    bounds: where each text begins, and the end. Windows don't reach over a bound.
    """
    n, width = len(data), length - gram + 1
    starts_ok = np.zeros(n + 1, np.int32)
    sizes = np.diff(bounds)
    long = sizes >= length
    if not long.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    np.add.at(starts_ok, bounds[:-1][long], 1)
    np.add.at(starts_ok, bounds[1:][long] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(starts_ok[:-1]) > 0)
    prefix = prefix_hashes(data)
    hashes = _mixed((prefix[gram:] - prefix[:-gram]) * _powers(n + 1)[1][: n - gram + 1])
    bits = np.uint64(max(1, int(n).bit_length()))
    ranked = (hashes >> bits << bits) | np.arange(n - gram + 1, dtype=np.uint64)
    least = _sliding_least(ranked, width)[windows]
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(place)) - 1
    return hashes[place[first]], place[first], windows[first], windows[last]


ANCHORS = "id long, tag long, at long, before int, behind int, h long, c1 long, c2 long"


def _pieces(texts: Iterable[tuple]) -> Iterator[tuple[list, list[int], bytes, np.ndarray]]:
    """Texts laid end to end, up to about PIECE bytes; long ones cut so that each window is in one piece."""
    ids: list = []
    offsets: list[int] = []
    parts: list[bytes] = []
    total = 0

    def done():
        return ids, offsets, b"".join(parts), np.cumsum([0, *map(len, parts)])

    for doc, data in texts:
        for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
            part = data[at : at + PIECE + LENGTH - 1] if len(data) > PIECE else data
            if len(part) < LENGTH:
                break
            ids.append(doc)
            offsets.append(at)
            parts.append(part)
            total += len(part)
            if total >= PIECE:
                yield done()
                ids, offsets, parts, total = [], [], [], 0
            if part is data:
                break
    if ids:
        yield done()


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = zip(range(batch.num_rows), (t.as_py() for t in batch.column(1).cast(pa.large_binary())))
        for ids, offsets, raw, bounds in _pieces(texts):
            data = np.frombuffer(raw, np.uint8)
            h, place, first, last = anchors(data, bounds)
            which = np.searchsorted(bounds, place, side="right") - 1
            shift = np.asarray(offsets)[which] - bounds[which]
            digests = b"".join([hashlib.blake2b(raw[a : b + LENGTH], digest_size=16).digest() for a, b in zip(first.tolist(), last.tolist())])
            c = np.frombuffer(digests, "<i8").reshape(-1, 2)
            rows = pa.array(np.asarray(ids, np.int64)[which])
            columns = (place + shift, (place - first).astype(np.int32), (last + LENGTH - place).astype(np.int32), h.view(np.int64), c[:, 0], c[:, 1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), *[pa.array(x) for x in columns]], names=["id", "tag", "at", "before", "behind", "h", "c1", "c2"])


# ---- runs of one anchor ------------------------------------------------------------------------


class Side:
    """Strings that begin at one point, read away from it: their bytes and prefix hashes."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.hashes = [array("Q", prefix_hashes(np.frombuffer(s, np.uint8)).tobytes()) for s in strings]

    def common(self, i: int, j: int) -> int:
        """Longest common extension of strings i and j: binary search over prefix hashes, verified on the bytes."""
        a, b = self.hashes[i], self.hashes[j]
        low, high = 0, min(len(a), len(b)) - 1
        while low < high:
            middle = (low + high + 1) // 2
            if a[middle] == b[middle]:
                low = middle
            else:
                high = middle - 1
        s, t = self.strings[i], self.strings[j]
        if s[:low] != t[:low]:  # hashes collide: the bytes decide
            low = next(k for k in range(low) if s[k] != t[k])
        return low

    def compare(self, i: int, j: int) -> int:
        k = self.common(i, j)
        s, t = self.strings[i], self.strings[j]
        return (s[k : k + 1] > t[k : k + 1]) - (s[k : k + 1] < t[k : k + 1])

    def sorted(self) -> list[int]:
        """The strings in order: a mergesort by compare()."""
        return sorted(range(len(self.strings)), key=cmp_to_key(self.compare))


def repeated_parts(runs: list[tuple[bytes, int]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For runs (bytes, place of the anchor in them), the parts of each that a window shared with another covers."""
    out: list[list[tuple[int, int]]] = [[] for _ in runs]
    right = Side([data[at:] for data, at in runs])
    left = Side([data[:at][::-1] for data, at in runs])
    order = right.sorted()
    rank = {i: r for r, i in enumerate(left.sorted())}
    by_rank = sorted(rank, key=rank.__getitem__)
    joints = sorted(((right.common(i, j), k) for k, (i, j) in enumerate(zip(order, order[1:]))), reverse=True)
    of, sets = list(range(len(order))), [[rank[i]] for i in order]

    def root(k: int) -> int:
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    def meet(i: int, j: int, ahead: int) -> None:
        back = left.common(i, j)
        if back + ahead >= length:
            for x in (i, j):
                out[x].append((runs[x][1] - back, runs[x][1] + ahead))

    for ahead, k in joints:
        a, b = root(k), root(k + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large, small = sets[a], sets[b]
        for r in small:
            at = bisect_left(large, r)
            # Only neighbours count: beyond them, runs already joined share more on both sides.
            if at:
                meet(by_rank[r], by_rank[large[at - 1]], ahead)
            if at < len(large):
                meet(by_rank[r], by_rank[large[at]], ahead)
            large.insert(at, r)
        of[b] = a
        sets[b] = []
    return [merged(parts) for parts in out]


def merged(parts: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, id, tag, at, before, alone, data) come sorted by h; an anchor's rows may go on in the next batch."""
    held: list[tuple] = []

    def settle(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        found = []
        if len(rows) > 1:
            for (_, doc, tag, at, before, alone, _), parts in zip(rows, repeated_parts([(r[6], r[4]) for r in rows])):
                if alone:
                    found += [(doc, tag, at - before + a, at - before + b) for a, b in parts]
        return found

    def batch_of(found: list) -> pa.RecordBatch:
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "tag", "a", "b"])

    for batch in batches:
        found = []
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0][0] != row[0]:
                found += settle(held)
                held = []
            held.append(row)
        yield batch_of(found)
    yield batch_of(settle(held))


# ---- the whole corpus --------------------------------------------------------------------------


def _slice_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each document."""
    names = ["h", "id", "tag", "at", "before", "alone", "n", "data"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for doc, tag, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3)):
            data = text.as_py()
            for w in wanted.as_py():
                part = data[w["at"] - w["before"] : w["at"] + w["behind"]]
                rows.append((w["h"], doc, tag, w["at"], w["before"], w["alone"], w["n"], part))
                size += len(part)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


SLICES = "h long, id long, tag long, at long, before int, alone boolean, n long, data binary"


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, place in the run, digest) of every window of a run, with the document's place."""
    for batch in batches:
        for h, doc, tag, at, before, alone, _, data in zip(*[c.to_pylist() for c in batch.columns]):
            n = len(data) - LENGTH + 1
            digests = b"".join([hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest() for k in range(n)])
            c = np.frombuffer(digests, "<i8").reshape(-1, 2)
            columns = [np.full(n, h), np.full(n, doc), np.full(n, tag), at - before + np.arange(n), np.full(n, alone), c[:, 0], c[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "id", "tag", "a", "alone", "c1", "c2"])


def repeated_spans(rows: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(id, tag, a, b): byte spans of rows (id, text, tag) that repeated strings cover; spans may overlap."""
    found = stored(rows.mapInArrow(_anchor_batches, ANCHORS))
    key, row = ["h", "c1", "c2"], ["id", "tag"]
    kinds = stored(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "tag", "at", "before", "behind")).alias("rep")))
    copies = kinds.where(F.col("n") > 1).select(*key)
    whole = found.join(copies, key, "left_semi").select(*row, (F.col("at") - F.col("before")).alias("a"), (F.col("at") + F.col("behind")).alias("b"))

    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("runs"), F.min("n").alias("least")).where((F.col("runs") > 1) & (F.col("least") == 1))
    wanted = kinds.join(several, "h").select("h", "rep.*", (F.col("n") == 1).alias("alone"), F.col("runs").alias("n"))
    per_doc = wanted.groupBy(*row).agg(F.collect_list(F.struct("h", "at", "before", "behind", "alone", "n")).alias("wanted"))
    slices = rows.join(per_doc, row).select(*row, "text", "wanted").mapInArrow(_slice_batches, SLICES)
    slices = stored(slices)
    few = slices.where(F.col("n") <= hot_runs).select("h", *row, "at", "before", "alone", "data")
    parts = few.repartition("h").sortWithinPartitions("h").mapInArrow(_part_batches, "id long, tag long, a long, b long")

    windows = slices.where(F.col("n") > hot_runs).mapInArrow(_window_batches, "h long, id long, tag long, a long, alone boolean, c1 long, c2 long")
    twice = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(*key)
    hot = windows.where("alone").join(twice, key, "left_semi").select(*row, "a", (F.col("a") + LENGTH).alias("b"))
    return whole.unionByName(parts).unionByName(hot)


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2)):
            data = text.as_py()
            removed = merged([(s["a"], s["b"]) for s in spans.as_py() or ()])
            digest, at, kept = hashlib.sha256(), 0, []
            for a, b in [*removed, (len(data), len(data))]:
                digest.update(data[at:a])
                kept.append(data[at:a])
                at = b
            out.append((doc, len(data), sum(b - a for a, b in removed), len(removed), digest.hexdigest(), b"".join(kept)))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept."""
    rows = docs.select(id_of().alias("id"), text_or_empty().alias("text"), tag_of().alias("tag"))
    spans = repeated_spans(rows, hot_runs).groupBy("id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    joined = rows.join(spans, ["id", "tag"], "left")
    return joined.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "spans").mapInArrow(_remove_batches, REMOVED)
