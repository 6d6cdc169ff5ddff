"""N-best segmentation with a public SentencePiece vocabulary, and decoding.

The score of a segmentation is the sum of its pieces' scores. A forward Viterbi pass over the
piece lattice gives the best score of every prefix; these are exact heuristics for an A-star
search that runs backward from the end, so the n best segmentations leave the search in order
and no others are expanded. No tokenizer is trained: scores and pieces are the model's own.

No piece of the vocabulary reaches over the start of a word or over a character that has no
piece, which is checked when the model is loaded. The lattice of a text therefore is a chain of
small lattices, which recur. For each link the best and the loss of the second best are found
once and remembered, by one forward pass over all new links of many texts side by side; the n-1 links with the least loss, the only ones in which one of the n best
can deviate, are searched in full, and the n best of the chain come best first over the losses.

A character without a piece is spelled in the model's byte pieces, at the score of an unknown
piece: 10 below the lowest score. A literal U+2581, which stands for a space in pieces, is
spelled in bytes too, so decoding gives back the text exactly.

Ties between segmentations are broken depth first, the longest piece first.

Defined cases: a null or empty text has no pieces, the score 0, one segmentation, and decodes to
an empty text; very long texts are segmented whole, link by link, in time linear in their length;
equal rows get equal results, and rows that repeat an id are encoded each by its own text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import add, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Links of a generation, and parts of links, that a worker remembers: about 350 bytes each, two generations of both.
REMEMBERED_LINKS = 300_000
REMEMBERED_PARTS = 50_000
#: Links searched in full that a worker remembers.
REMEMBERED_SEARCHES = 20_000
#: Longer links are searched without being remembered, and one by one.
LONG_LINK = 64
#: New links that go through the forward pass side by side.
SIDE_BY_SIDE = 4_096
#: Texts whose links are looked up together: so many characters, or one text that is longer.
TOGETHER = 2_000_000


class Vocabulary:
    """Pieces and scores of a model file, and the segmentations found so far.

    as_text: segmentations are held as text (ids in decimal, a space after each), else as 32-bit numbers.
    """

    def __init__(self, model: bytes, n_best: int = N_BEST, as_text: bool = False) -> None:
        import sentencepiece

        self.n_best, self.as_text = n_best, as_text
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.ids: dict[str, int] = {}
        self.scores: dict[int, float] = {}
        self.bytes: dict[int, int] = {}
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.scores[i] = sp.get_score(i)
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.shown = [piece.replace(SPACE, " ") for piece in self.pieces]
        self.byte_values = {i: b for b, i in self.bytes.items()}
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.ids))
        chars = {c for piece in self.ids for c in piece}
        linked = not any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        #: Links: a character that no piece has (a line break), or spaces and the word after them.
        alone = "\n" not in chars
        self.links = re.compile(r"\n| *[^ \n]+| +" if alone else r" *[^ ]+| +") if linked else re.compile(r"(?s).+")
        self.split_at_spaces = linked and alone
        #: Pieces by character: (what follows, score, id) of a prefix, the score None if it is no piece.
        tree: dict = {}
        for piece, i in self.ids.items():
            node = tree
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = (self.scores[i], i)
        frozen = lambda node: {char: (frozen(x), *x.get("", (None, 0))) for char, x in node.items() if char}
        self.trie: dict = frozen(tree)
        self._lay_out_trie()
        self.texts = [b"%d " % i for i in range(len(self.pieces))]
        #: Pairs of characters, as in texts, that stand side by side in a piece.
        self.beside = {pair.replace(SPACE, " ") for piece in self.ids for pair in map("".join, zip(piece, piece[1:]))}
        self.found: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.known: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}
        self.searched: dict[str, list] = {}

    def _lay_out_trie(self) -> None:
        """The trie as arrays, for many links at once: the child of node x by character c stands at place[x] + c if
        owner there is x. Nodes with most children are placed first, each at the first free places that it tries."""
        chars = sorted({c for piece in self.ids for c in piece})
        code = {c: k for k, c in enumerate(chars, 1)}
        children: list[dict[int, int]] = [{}]
        score, ids = [-_INF], [-1]
        for piece, i in self.ids.items():
            at = 0
            for char in piece:
                if (then := children[at].get(code[char])) is None:
                    then = children[at][code[char]] = len(children)
                    children.append({})
                    score.append(-_INF)
                    ids.append(-1)
                at = then
            score[at], ids[at] = self.scores[i], i
        size = 4 * len(children)
        owner, child, place = [-1] * (size + len(code) + 1), [0] * (size + len(code) + 1), [0] * len(children)
        for node in sorted(range(len(children)), key=lambda x: -len(children[x])):
            if children[node]:
                base = node * 2_654_435_761 % size
                while any(owner[base + c] >= 0 for c in children[node]):
                    base = (base + 1) % size
                place[node] = base
                for c, then in children[node].items():
                    owner[base + c], child[base + c] = node, then
        self.place, self.owner, self.child = (np.array(x, np.int32) for x in (place, owner, child))
        self.node_score, self.node_id = np.array(score), np.array(ids, np.int32)
        #: Number of a character of a text, 0 if no piece is that character alone.
        self.code = np.zeros(0x110000, np.int32)
        for char, k in code.items():
            if char in self.ids and char not in (" ", SPACE):
                self.code[ord(char)] = k
        if SPACE in self.ids:
            self.code[ord(" ")] = code[SPACE]

    def two_best_of_many(self, texts: list[str]) -> list[tuple[float, tuple[int, ...], float] | None]:
        """two_best() of each text, all in one forward pass over arrays; None where a character has no piece."""
        out: list = [None] * len(texts)
        lengths = np.array([len(x) for x in texts], np.int64)
        for chosen in np.array_split(np.argsort(-lengths, kind="stable"), -(-len(texts) // SIDE_BY_SIDE) or 1):
            n, m = lengths[chosen], len(chosen)
            codes = np.zeros((int(n.max(initial=0)), m), np.int32)
            column = np.repeat(np.arange(m), n)
            row = np.arange(len(column)) - np.repeat(np.cumsum(n) - n, n)
            raw = "".join([texts[k] for k in chosen.tolist()]).encode("utf-32-le", "surrogatepass")
            codes[row, column] = self.code[np.frombuffer(raw, np.uint32)]
            usable = np.bincount(column, codes[row, column] == 0, m) == 0
            for k, got in zip(chosen[usable].tolist(), self._pass_over(codes[:, usable], n[usable])):
                out[k] = got
        return out

    def _pass_over(self, codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[float, tuple[int, ...], float]]:
        """codes: a column for each text, longest first, 0 after its end."""
        width, m = codes.shape
        one, two = np.full((width + 1, m), -_INF), np.full((width + 1, m), -_INF)
        back, piece = np.zeros((width + 1, m), np.int32), np.zeros((width + 1, m), np.int32)
        one[0] = 0.0
        for start in range(width):
            rows = np.arange(int(np.count_nonzero(n > start)))
            node = np.zeros(len(rows), np.int32)
            for end in range(start + 1, width + 1):
                at = self.place[node] + codes[end - 1, rows]
                on = self.owner[at] == node
                rows, node = rows[on], self.child[at[on]]
                if not len(rows):
                    break
                score = self.node_score[node]
                whole = score > -_INF
                r, score = rows[whole], score[whole]
                # As in two_best(): pieces come longest first to each end, and of equal scores the first stays.
                x, y = one[start, r] + score, one[end, r]
                better = x > y
                two[end, r] = np.maximum(np.where(better, y, two[end, r]), np.where(better, two[start, r] + score, x))
                r = r[better]
                one[end, r], back[end, r], piece[end, r] = x[better], start, self.node_id[node[whole][better]]
        every = np.arange(m)
        best, loss = one[n, every], one[n, every] - two[n, every]
        rows, at, steps = every, n, []
        while len(rows):
            steps.append((rows, piece[at, rows]))
            at = back[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        counts = np.bincount(np.concatenate([every[:0], *[r for r, _ in steps]]), minlength=m)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(bounds[-1], np.int32)
        for k, (r, i) in enumerate(steps, 1):
            flat[bounds[1:][r] - k] = i
        ids, bounds = flat.tolist(), bounds.tolist()
        for k, (top, lost) in enumerate(zip(best.tolist(), loss.tolist())):
            yield top, tuple(ids[bounds[k] : bounds[k + 1]]), lost

    def lattice(self, text: str) -> tuple[str, list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """For each end: its pieces as (start, score, ids), longest first, and the best score of each prefix."""
        shown = text.replace(SPACE, "￿").replace(" ", SPACE)
        n, ids, scores = len(shown), self.ids, self.scores
        ends: list[list[tuple[int, float, tuple[int, ...]]]] = [[]]
        best = [0.0]
        for end in range(1, n + 1):
            here, top = [], float("-inf")
            for start in range(max(0, end - self.longest), end):
                i = ids.get(shown[start:end])
                if i is not None:
                    s = scores[i]
                    here.append((start, s, (i,)))
                    if best[start] + s > top:
                        top = best[start] + s
            if not here or here[-1][0] != end - 1:
                s = self.unknown
                here.append((end - 1, s, tuple(self.bytes[b] for b in text[end - 1].encode("utf-8", "surrogatepass"))))
                if best[end - 1] + s > top:
                    top = best[end - 1] + s
            ends.append(here)
            best.append(top)
        return shown, ends, best

    def search(self, text: str, n_best: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of text (a dummy space is not added) as (score, ids), best first."""
        _, ends, best = self.lattice(text)
        heap: list[tuple] = [(-best[-1], 0, len(text), 0.0, ())]
        out: list[tuple[float, tuple[int, ...]]] = []
        turn = 0
        while heap and len(out) < (n_best or self.n_best):
            _, _, at, gained, path = heapq.heappop(heap)
            if not at:
                ids: list[int] = []
                while path:
                    piece, path = path
                    ids += piece
                out.append((gained, tuple(ids)))
                continue
            for start, score, piece in reversed(ends[at]):
                turn -= 1
                total = gained + score
                heapq.heappush(heap, (-(total + best[start]), turn, start, total, (piece, path)))
        return out

    def two_best(self, text: str) -> tuple[float, tuple[int, ...], float]:
        """Best score and ids, and how much the second best loses: a forward pass over the trie of pieces that
        keeps two scores at each place."""
        shown = text.replace(SPACE, "￿").replace(" ", SPACE)
        n, low, trie = len(shown), -_INF, self.trie
        one, two, back = [low] * (n + 1), [low] * (n + 1), [None] * (n + 1)
        one[0] = 0.0
        for start in range(n):
            a, b, end = one[start], two[start], start
            after, covered = trie, False
            while after and end < n:
                node = after.get(shown[end])
                if node is None:
                    break
                after, score, i = node
                end += 1
                if score is not None:
                    x = a + score
                    y = one[end]
                    if x > y:
                        z = b + score
                        two[end] = y if y > z else z
                        one[end] = x
                        back[end] = start, i
                    elif x > two[end]:
                        two[end] = x
                    if end == start + 1:
                        covered = True
            if not covered:
                x, end = a + self.unknown, start + 1
                if x > one[end]:
                    two[end] = max(one[end], b + self.unknown)
                    one[end], back[end] = x, (start, -1)
                elif x > two[end]:
                    two[end] = x
        parts, at = [], n
        while at:
            start, i = back[at]
            parts.append((i,) if i >= 0 else tuple(self.bytes[x] for x in text[start:at].encode("utf-8", "surrogatepass")))
            at = start
        return one[n], tuple(chain.from_iterable(reversed(parts))), one[n] - two[n]

    def link(self, text: str) -> tuple[float, bytes, float, int, bool]:
        """(score, form of the ids, loss of the second best, number of ids, whether they decode to the link), from the
        link's parts: between two characters that stand side by side in no piece, the lattice falls apart."""
        got = self.older.pop(text, None)
        if got is not None:
            self._remember(text, got)
            return got
        beside, known = self.beside, self.known
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in beside]
        score, ids, loss, begun = 0.0, (), _INF, 0
        for end in (*cuts, len(text)):
            part = text[begun:end]
            begun = end
            found = known.get(part)
            if found is None:
                found = self.before.pop(part, None) or self.two_best(part)
                if len(known) >= REMEMBERED_PARTS:
                    self.before, self.known = known, {}
                    known = self.known
                known[part] = found
            score += found[0]
            ids += found[1]
            if found[2] < loss:
                loss = found[2]
        got = (score, self.form(ids), loss, len(ids), self._shown(ids) == text)
        if len(text) <= LONG_LINK:
            self._remember(text, got)
        return got

    def all_links(self, links: Iterable[str]) -> dict[str, tuple]:
        """link() of each of the links; short ones that are not remembered are settled side by side."""
        out, new = {}, []
        for text in set(links):
            if len(text) > LONG_LINK or text in self.found or text in self.older:
                out[text] = self.found.get(text) or self.link(text)
            else:
                new.append(text)
        for text, best in zip(new, self.two_best_of_many(new)):
            if best is None:
                out[text] = self.link(text)
                continue
            score, ids, loss = best
            got = out[text] = (score, self.form(ids), loss, len(ids), self._pieces_shown(ids) == text)
            self._remember(text, got)
        return out

    def _remember(self, text: str, got: tuple) -> None:
        """Links are kept for two generations, so that a full table doesn't forget the frequent ones."""
        if len(self.found) >= REMEMBERED_LINKS:
            self.older, self.found = self.found, {}
        self.found[text] = got

    def form(self, ids) -> bytes:
        return b"".join([self.texts[i] for i in ids]) if self.as_text else np.array(ids, np.int32).tobytes()

    def of_form(self, form: bytes) -> list[int]:
        return list(map(int, form.split())) if self.as_text else np.frombuffer(form, np.int32).tolist()

    def links_of(self, text: str) -> list[str]:
        """The links of a whole text, with the dummy space before it."""
        if not text:
            return []
        text = " " + text
        if self.split_at_spaces and "  " not in text and "\0" not in text:
            return list(filter(None, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
        return self.links.findall(text)

    def chains(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[tuple]]]:
        """The links of each text and what link() finds for them."""
        held: list[tuple[list[str], list]] = []
        size = 0

        def settled() -> list[tuple[list[str], list[tuple]]]:
            missing = [[k for k, x in enumerate(got) if x is None] if None in got else [] for _, got in held]
            new = self.all_links(links[k] for (links, _), places in zip(held, missing) for k in places)
            for (links, got), places in zip(held, missing):
                for k in places:
                    got[k] = new[links[k]]
            return held

        for text in texts:
            if held and size + len(text) > TOGETHER:
                yield from settled()
                held, size = [], 0
            links = self.links_of(text)
            held.append((links, list(map(self.found.get, links))))
            size += len(text)
        yield from settled()

    def ranked_changes(self, links: list[str], got: list[tuple]) -> list[tuple[float, list[tuple]]]:
        """The n best results of the chain as (score, changes): pairs of a link's place and its other ids."""
        n, top = self.n_best, sum(map(_SCORE, got))
        # A result deviates in at most n-1 links, and only where the first loss is among the n-1 least.
        firsts = np.fromiter(map(_LOSS, got), np.float64, len(got))
        limit = np.partition(firsts, n - 2)[n - 2] if 1 < n <= len(got) else _INF
        places = sorted(np.flatnonzero(firsts <= limit).tolist(), key=firsts.__getitem__)[: n - 1]
        near = [(k, results) for k in places if len(results := self.searched.get(links[k]) or self._search_link(links[k])) > 1]
        loss_of = lambda j, rank: near[j][1][0][0] - near[j][1][rank][0]
        out: list[tuple[float, list[tuple]]] = [(top, [])]
        heap = [(loss_of(j, 1), ((j, 1),)) for j in range(len(near))]
        heapq.heapify(heap)
        while heap and len(out) < n:
            loss, changes = heapq.heappop(heap)
            out.append((top - loss, [(near[j][0], near[j][1][rank][1]) for j, rank in changes]))
            j, rank = changes[-1]
            if rank + 1 < len(near[j][1]):
                heapq.heappush(heap, (loss - loss_of(j, rank) + loss_of(j, rank + 1), (*changes[:-1], (j, rank + 1))))
            for further in range(j + 1, len(near)):
                heapq.heappush(heap, (loss + loss_of(further, 1), (*changes, (further, 1))))
        return out

    def _search_link(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """search(), remembered: the links that lose least are few and recur."""
        got = self.search(text)
        if len(text) <= LONG_LINK:
            if len(self.searched) >= REMEMBERED_SEARCHES:
                self.searched = {}
            self.searched[text] = got
        return got

    def forms_of(self, got: list[tuple], ranked: list[tuple[float, list[tuple]]]) -> list[tuple[bytes, int]]:
        """The forms of whole segmentations, and their numbers of ids."""
        best, n = list(map(_FORM, got)), sum(map(_COUNT, got))
        out = []
        for _, changes in ranked:
            forms, count = best.copy() if changes else best, n
            for k, ids in changes:
                forms[k] = self.form(ids)
                count += len(ids) - got[k][3]
            out.append((b"".join(forms), count))
        return out

    def n_best_chain(self, text: str) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text as (score, ids), best first."""
        links, got = next(self.chains([text]))
        ranked = self.ranked_changes(links, got)
        return [(score, self.of_form(form)) for (score, _), (form, _) in zip(ranked, self.forms_of(got, ranked))]

    def restores(self, text: str, links: list[str], got: list[tuple]) -> bool:
        """Whether the best ids decode to the text: every link's to the link, and the links make up the text."""
        return all(map(_RESTORED, got)) and "".join(links)[1:] == text

    def decode(self, ids) -> str:
        """The text of a segmentation: pieces and bytes joined, the dummy space taken off."""
        return self._shown(ids)[1:]

    def _shown(self, ids) -> str:
        shown, values = self.shown, self.byte_values
        if values.keys().isdisjoint(ids):
            return self._pieces_shown(ids)
        out: list[str] = []
        for is_byte, run in groupby(ids, values.__contains__):
            out.append(bytes([values[i] for i in run]).decode("utf-8", "surrogatepass") if is_byte else "".join([shown[i] for i in run]))
        return "".join(out)

    def _pieces_shown(self, ids) -> str:
        """_shown() of ids that have no byte pieces among them."""
        shown = self.shown
        return "".join([shown[i] for i in ids])


#: Fields of what link() finds.
_SCORE, _FORM, _LOSS, _COUNT, _RESTORED = map(itemgetter, range(5))
_INF = float("inf")
_LOADED: dict[tuple, Vocabulary] = {}


def vocabulary(model: bytes, n_best: int = N_BEST, as_text: bool = False) -> Vocabulary:
    """One per worker: what it has found serves its later tasks. Another model or form takes its place."""
    key = (hashlib.sha256(model).digest(), n_best, as_text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(model, n_best, as_text)
    return _LOADED[key]


def load(docs: DataFrame, path: str):
    """The model file, broadcast: read on the driver, of a fixed size of about half a megabyte."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _numbers(forms: list[bytes]) -> pa.Array:
    """Lists of 32-bit numbers from their bytes."""
    bounds = np.cumsum([0, *map(len, forms)]) // 4
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.frombuffer(b"".join(forms), np.int32)))


ENCODED = "doc_id long, ids array<int>, n_pieces long, score double, scores array<double>, n_best array<array<int>>, restored boolean, n_best_pieces array<long>, n_best_sha256 array<string>"


def encode(docs: DataFrame, path: str = MODEL, n_best: int = N_BEST, alternatives: bool = False, digests: bool = False) -> DataFrame:
    """One row per document: the best ids with their number and score, the n best scores, whether decoding
    gives the text back; with alternatives also the ids of all n results. With digests, the number of ids of
    each of the n results and the SHA-256 of its ids (as text, a space between) come instead of all ids."""
    model = load(docs, path)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value, n_best, digests)
        for batch in rows:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, tops, scores, restored, ids, others, lengths, sums = ([] for _ in range(8))
                texts = part.column(1).to_pylist()
                for text, (links, got) in zip(texts, v.chains(texts)):
                    ranked = v.ranked_changes(links, got)
                    forms = v.forms_of(got, ranked if alternatives or digests else ranked[:1])
                    restored.append(v.restores(text, links, got))
                    counts.append(forms[0][1])
                    tops.append(ranked[0][0])
                    scores.append([s for s, _ in ranked])
                    ids.append(None if digests else forms[0][0])
                    others.append([v.of_form(x) for x, _ in forms] if alternatives else None)
                    lengths.append([n for _, n in forms] if digests else None)
                    sums.append([hashlib.sha256(x[:-1]).hexdigest() for x, _ in forms] if digests else None)
                columns = [
                    part.column(0), pa.nulls(part.num_rows, pa.list_(pa.int32())) if digests else _numbers(ids), pa.array(counts, pa.int64()), pa.array(tops, pa.float64()), pa.array(scores, pa.list_(pa.float64())),
                    pa.array(others, pa.list_(pa.list_(pa.int32()))), pa.array(restored, pa.bool_()), pa.array(lengths, pa.list_(pa.int64())), pa.array(sums, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_pieces", "score", "scores", "n_best", "restored", "n_best_pieces", "n_best_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(batches, ENCODED)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text from rows with doc_id and ids (null: empty)."""
    model = load(encoded, path)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model.value)
        for batch in rows:
            texts = [v.decode(ids.as_py()) if ids.is_valid else "" for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(batches, "doc_id long, text string")
