import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash as sh
from tidemark.llm.components import components


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints):
    """Brute force: flood over all pairs at two or fewer differing bits."""
    out, ids = {}, sorted(prints)
    for start in ids:
        if start in out:
            continue
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for y in ids:
                if y not in seen and (prints[x] ^ prints[y]).bit_count() <= 2:
                    seen.add(y)
                    todo.append(y)
        out |= {x: start for x in seen}
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c", "É x  y\x0bz a b É x y", "the cat " * 300])
def test_fingerprint(text):
    assert sh.simhash(text) == plain(text)


def test_pairs_of_a_bucket_against_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64)) for _ in range(25)]]))
    prints = prints[np.argsort(sh.gray_rank(prints))]
    got = {(int(a), int(b)) for x, y in sh.linked_pairs(np.zeros(len(prints), np.int64), prints) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 2}
    assert got == want


def test_gray_rank_orders_neighbours():
    ranks = sh.gray_rank(np.array([i ^ (i >> 1) for i in range(1000)], dtype=np.uint64))
    assert list(ranks) == list(range(1000))


@pytest.mark.parametrize("hot", [20_000, 2])
def test_components_of_documents(spark, hot):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", " ", "alone"]
    for _ in range(12):
        doc = list(rng.choice(words, 400))
        for _ in range(8):
            texts.append(" ".join(doc))
            doc[int(rng.integers(400))] = "changed"
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    rows.append(rows[-1])
    got = sh.near_groups(spark.createDataFrame(rows, "doc_id long, text string, component string"), hot).collect()
    prints = {i: plain(t) for i, t, _ in rows}
    want = least_reachable(prints)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_of_clustered_fingerprints(spark):
    rng = np.random.default_rng(5)
    prints = set()
    for _ in range(5):
        x = int(rng.integers(0, 2**63))
        for _ in range(60):
            x ^= (1 << int(rng.integers(64))) | (1 << int(rng.integers(64)))
            prints.add(x)
    prints = dict(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "id long, print long")
    for hot in (20_000, 3):
        got = {r.id: r.component for r in components(sh.links(df, hot)).collect()}
        assert {i: got.get(i, i) for i in prints} == least_reachable(prints)


def test_empty(spark):
    assert sh.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert sh.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0
