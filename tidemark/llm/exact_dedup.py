"""Exact deduplication by composable polynomial fingerprints.

A text is normalised by deleting white space. Its UTF-8 bytes are cut into chunks; each chunk
gets a polynomial hash modulo 2^61-1, and hashes of neighbours combine by a length-shifted
sum: H(uv) = H(u) * B^len(v) + H(v). So the chunks of a huge document are hashed by different
tasks and only (hash, length) pairs meet. Documents with equal fingerprints are compared with
one of them chunk by chunk, stopping at the first difference; what differs in spite of an equal
fingerprint is grouped by its SHA-256 instead.

Defined cases: a null text counts as empty; empty texts are equal to each other; ties go to
the smallest id; a huge text is hashed and compared in pieces, though the last comparison has two
whole texts in one row; rows that repeat an id are judged each by its own text, and copies of the
row that stays, with its id, stay too; a null id is an id like any other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE_BYTES, cut, id_of, rows_of, tag_of, text_or_empty

PRIME = (1 << 61) - 1
BASE = 1_000_003_900_133
#: Bytes that one step of the vectorised hash takes.
CHUNK = 1 << 14
#: Documents over this many characters are hashed in pieces by several tasks.
HUGE_CHARS = 1 << 22


def normalise(text: str | bytes | None) -> bytes:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(None, WHITE_BYTES)


def combine(left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
    """(hash, length) of the concatenation, from those of its two parts."""
    return (left[0] * pow(BASE, right[1], PRIME) + right[0]) % PRIME, left[1] + right[1]


_LIMBS: dict[int, np.ndarray] = {}


def _limbs() -> np.ndarray:
    """Powers B^(CHUNK/4-1) ... B^0 modulo the prime, cut into limbs of 21 bits, as doubles (3 x CHUNK/4)."""
    if 0 not in _LIMBS:
        powers, value = [], 1
        for _ in range(CHUNK // 4):
            powers.append(value)
            value = value * BASE % PRIME
        powers = powers[::-1]
        _LIMBS[0] = np.array([[p >> s & 0x1FFFFF for p in powers] for s in (0, 21, 42)], dtype=np.float64)
    return _LIMBS[0]


def chunk_hash(data: bytes) -> int:
    """Polynomial hash of at most CHUNK bytes, read as digits of 32 bits, the last one padded with zeros.

    A digit times a limb of 21 bits, over 2^12 digits, would pass 2^53; so digits are split into
    halves of 16 bits, whose products sum exactly in doubles.
    """
    words = np.frombuffer(data + b"\0" * (-len(data) % 4), dtype=">u4")
    limbs = _limbs()[:, -len(words) :] if len(words) else _limbs()[:, :0]
    low, high = limbs @ (words & 0xFFFF).astype(np.float64), limbs @ (words >> 16).astype(np.float64)
    return sum((int(a) + (int(b) << 16)) << s for a, b, s in zip(low, high, (0, 21, 42))) % PRIME


def fingerprint(data: bytes) -> tuple[int, int]:
    """(hash, length in digits) of normalised bytes, chunk after chunk.

    All chunks but the last are full, so digits begin at every fourth byte. The byte length is kept beside the fingerprint, so that padding can't make texts of different length equal.
    """
    state = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        state = combine(state, (chunk_hash(part), (len(part) + 3) // 4))
    return state


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, sizes, shas = [], [], []
        for text in batch.column(1).cast(pa.large_binary()):
            data = normalise(text.as_py())
            prints.append(fingerprint(data)[0])
            sizes.append(len(data))
            shas.append(hashlib.sha256(data).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), batch.column(2), pa.array(shas, pa.string())],
            names=["doc_id", "tag", "print", "n_bytes", "n_chars", "text_sha256"],
        )


def _same_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same = [equal_in_chunks(a.as_py(), b.as_py()) for a, b in zip(batch.column(1).cast(pa.large_binary()), batch.column(2).cast(pa.large_binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(same, pa.bool_())], names=["id", "tag", "same"])


def equal_in_chunks(a: bytes | None, b: bytes | None, chunk: int = 1 << 16) -> bool:
    """Whether two texts are equal when normalised; reads both in steps and stops at a difference."""
    a, b = a or b"", b or b""
    if a == b:
        return True
    at_a = at_b = 0
    left = right = b""
    while True:
        while not left and at_a < len(a):
            left, at_a = normalise(a[at_a : at_a + chunk]), at_a + chunk
        while not right and at_b < len(b):
            right, at_b = normalise(b[at_b : at_b + chunk]), at_b + chunk
        n = min(len(left), len(right))
        if not n:
            return not left and not right
        if left[:n] != right[:n]:
            return False
        left, right = left[n:], right[n:]


HASHED = "doc_id long, tag long, print long, n_bytes long, n_chars long, text_sha256 string"


def fingerprints(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """doc_id, tag, print, n_bytes (normalised), n_chars (original), text_sha256 of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).select("*", F.length("text").cast("long").alias("n_chars"), tag_of().alias("tag"))
    small = rows.where(F.col("n_chars") <= huge_chars).mapInArrow(_hash_batches, HASHED)
    # The pieces of a huge document: cut by characters, normalised and cut again by bytes within
    # a task. SHA-256 can't be composed, so one task streams it over the whole text.
    huge = rows.where(F.col("n_chars") > huge_chars)
    return small.unionByName(_huge(huge, huge_chars))


def _huge(huge: DataFrame, piece: int) -> DataFrame:
    pieces = huge.select("doc_id", "tag", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n_chars") - 1, F.lit(piece)), lambda at: F.substring(F.col("text"), (at + 1).cast("int"), F.lit(piece)))).alias("i", "text"))
    # A piece is normalised to a length that only its own task knows. Its digits start anew at the
    # document's digit boundary only if that length is a multiple of four, so bytes left over are
    # handed to the next piece: each row carries (its bytes modulo four) at both ends.
    hashed = pieces.distinct().repartition("doc_id", "tag", "i").mapInArrow(_piece_batches, "doc_id long, tag long, i int, n_bytes long, digests array<struct<shift:int,print:long,digits:long,tail:binary,head:binary>>")
    joined = hashed.groupBy("doc_id", "tag").agg(F.array_sort(F.collect_list(F.struct("i", "n_bytes", "digests"))).alias("pieces"))
    whole = joined.mapInArrow(_join_batches, "of_doc long, of_tag long, print long, n_bytes long")
    shas = huge.mapInArrow(_sha_batches, "doc_id long, tag long, n_chars long, text_sha256 string")
    found = shas.join(whole, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")))
    return found.select("doc_id", "tag", "print", "n_bytes", "n_chars", "text_sha256")


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each of the four places where the document's digits can begin in a piece, the hash of its whole digits."""
    for batch in batches:
        out = []
        for doc, tag, i, text in zip(*[c.to_pylist() for c in batch.columns]):
            data, digests = normalise(text), []
            for shift in range(4):
                head = data[:shift]
                body = data[shift:]
                tail = body[len(body) - len(body) % 4 :]
                h, digits = fingerprint(body[: len(body) - len(tail)])
                digests.append({"shift": shift, "print": h, "digits": digits, "tail": tail, "head": head})
            out.append({"doc_id": doc, "tag": tag, "i": i, "n_bytes": len(data), "digests": digests})
        yield from pa.Table.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("i", pa.int32()), ("n_bytes", pa.int64()), ("digests", pa.list_(pa.struct([("shift", pa.int32()), ("print", pa.int64()), ("digits", pa.int64()), ("tail", pa.binary()), ("head", pa.binary())])))])).to_batches()


def join_pieces(pieces: list[dict]) -> tuple[int, int]:
    """(hash, bytes) of a document from its pieces in order; the same as fingerprint() of the whole."""
    state, left, total = (0, 0), b"", 0
    for piece in pieces:
        total += piece["n_bytes"]
        digest = piece["digests"][-len(left) % 4]
        left += digest["head"]
        if len(left) == 4:
            state, left = combine(state, (chunk_hash(left), 1)), b""
        if not left:
            state, left = combine(state, (digest["print"], digest["digits"])), digest["tail"]
    if left:
        state = combine(state, (chunk_hash(left), 1))
    return state[0], total


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [join_pieces(pieces) for pieces in batch.column(2).to_pylist()]
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["of_doc", "of_tag", "print", "n_bytes"])


def _sha_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas = []
        for text in batch.column(1).cast(pa.large_binary()):
            digest, raw = hashlib.sha256(), text.as_buffer()
            for at in range(0, raw.size, 1 << 20):
                digest.update(normalise(raw.slice(at, min(1 << 20, raw.size - at)).to_pybytes()))
            shas.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), batch.column(2), pa.array(shas, pa.string())], names=["doc_id", "tag", "n_chars", "text_sha256"])


def groups(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return tagged_groups(docs, huge_chars).drop("tag")


def tagged_groups(docs: DataFrame, huge_chars: int = HUGE_CHARS) -> DataFrame:
    """As groups(), with the tag of the text that a row is about.

    Texts travel only for documents whose fingerprint occurs more than once. Every such document
    is compared with the one that stays for its fingerprint; adaptive joins split a fingerprint
    that many documents share, as no step needs a whole group in one task.
    """
    hashed = cut(fingerprints(docs, huge_chars)).withColumn("id", id_of())
    key = ["print", "n_bytes"]
    order = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("d"))
    best = F.max_by(F.col("doc_id"), order)
    shared = cut(hashed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("id", "tag"), order).alias("rep")).where(F.col("n") > 1))
    # Rows that repeat an id with its text are one.
    members = hashed.join(shared, key).select("id", "tag", F.col("rep.id").alias("rep_id"), F.col("rep.tag").alias("rep_tag")).dropDuplicates(["id", "tag"])
    members = members.withColumn("own", (F.col("id") == F.col("rep_id")) & (F.col("tag") == F.col("rep_tag")))
    texts = docs.select(id_of().alias("id"), text_or_empty().alias("text")).withColumn("tag", tag_of())
    with_text = texts.join(members, ["id", "tag"])
    reps = with_text.where("own").groupBy("id", "tag").agg(F.first("text").alias("rep_text")).withColumnsRenamed({"id": "rep_id", "tag": "rep_tag"})
    both = with_text.where("not own").join(reps, ["rep_id", "rep_tag"])
    same = cut(both.select("id", "text", "rep_text", "tag").mapInArrow(_same_batches, "id long, tag long, same boolean"))
    differ = same.where(~F.col("same")).select("id", "tag", F.lit(True).alias("differs")).distinct()
    marked = hashed.join(differ, ["id", "tag"], "left").withColumn("class", F.when(F.col("differs"), F.col("text_sha256")))
    sizes = marked.groupBy(*key, "class").agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))
    several = sizes.where(F.col("group_size") > 1).withColumnRenamed("class", "of_class").withColumnsRenamed({"print": "of_print", "n_bytes": "of_bytes"})
    joined = marked.join(several, (F.col("print") == F.col("of_print")) & (F.col("n_bytes") == F.col("of_bytes")) & F.col("class").eqNullSafe(F.col("of_class")), "left")
    keep = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
        "tag",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return rows_of(docs, tagged_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag")))
