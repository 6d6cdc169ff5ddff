"""Main text of web pages by wrapper inference: union-free regular expressions learned from each host.

A page is a stream of tokens: block elements and texts; parts of the page's frame by their role
(menus, headers outside the article, footers, sidebars, notices, adverts, forms, comments, scripts,
styles, hidden elements) are left out at once. The stream of a page is folded into an expression:
elements in order, texts, and repeated groups, where siblings or short sequences of them recur.
The expressions of a host's pages are aligned with each other, level by level: what only some of
them have becomes optional, what one repeats becomes a repeated group, a text that differs becomes
a slot, and orders that can't be aligned become a repeated group of optional elements. No
alternatives are kept, so the result is union-free, and its size is bounded by that of the
template. All pages of a host take part, whole: each task folds its own pages, and the tasks'
expressions are folded in rounds of FAN_IN.

A page is then read by its host's expression, with which it is aligned again. A text that met a
slot is content. A literal, the same text on every page that has it, is frame: outside an article
or main element from two pages, inside from three if every page of the host has it. Outside, so is
a repeated group whose texts are links, which is a menu. In a repeated group literals can't be told by their
place; there, texts at one path are counted over all pages of the host (copies of a page once), and
left out outside the article from a tenth of the pages (two at least), inside if all of them have
it (three at least). Where all that took half of the article or all of the page, the pages are
near copies of each other, and nothing is taken. A page with an article or main element keeps only
what is inside; where a host has one page, roles alone decide.

Defined cases: a null html counts as empty and gives an empty text; a null url has the host "";
very long pages are read whole, in time linear in their length; elements nested deeper than DEPTH
share the place of the one at that depth; tags that never close end with their parent; equal rows
give equal results, and rows that repeat an id are read each by its own html and url; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Expressions that one task folds at a time.
FAN_IN = 64
#: Children of a node before they are generalised to a repeated group of optional ones, and the depth of a place.
WIDE, DEPTH = 40, 40
#: Elements of a sequence that may repeat as a group, at most.
PERIOD = 4
#: Share of a repeated group's characters that stand in links, if it is a menu.
MENU_LINKS = 0.8
#: Bytes of all wrappers that are broadcast; beyond, pages meet them in a join.
BROADCAST_BYTES = 32 << 20

#: HTML elements by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
FRAME = frozenset(
    "nav footer aside form script style noscript template iframe object svg canvas button select textarea menu dialog head title "
    "video audio map math".split()
)
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "title", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "summary"}
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select", "menu")
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar tablist toolbar form".split())
#: Words that make a class or id name a part of the frame, and words that may stand beside them in it.
FRAME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored sponsors cookie cookies consent "
    "notice notices alert popup modal newsletter subscribe subscription signup login search share sharing social nav navbar "
    "navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside widget widgets related recommended "
    "recommendations footer comment comments reply replies respond disqus complementary contentinfo masthead topbar toolbar "
    "skip paywall gdpr".split()
)
BESIDE_WORDS = frozenset(
    "box bar wrap wrapper container list area section block slot unit inner outer item items group panel site page top bottom left right "
    "main primary secondary global header head body content form link links button buttons icon icons text title row col column the and "
    "post posts article articles story stories thread field overlay holder zone region".split()
)

#: Words beside "header" that make it the article's own.
OWN_HEADER = frozenset("article articles post posts story stories content section main body".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, value): ("open", tag, attributes), ("close", tag, ""), ("text", "", raw text)."""
    out: list[tuple[str, str, str]] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            out.append(("text", "", page[at:]))
            break
        if m.start() > at:
            out.append(("text", "", page[at : m.start()]))
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                out.append(("text", "", html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
            continue
        name = name.lower()
        if slash:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, attributes or ""))
        if name in RAW and not (attributes or "").rstrip().endswith("/"):
            end = _RAW_END[name].search(page, at)
            stop = end.start() if end else n
            if stop > at:
                out.append(("text", "", page[at:stop]))
            at = stop
    return out


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def names_frame(token: str, in_article: bool = False) -> bool:
    """Whether a class or id names a part of the frame: all its words do, or are such as stand beside those that do."""
    words = _PART.findall(_CAMEL.sub(r"\1 \2", token).lower())
    if not all(w in FRAME_WORDS or w in BESIDE_WORDS for w in words):
        return False
    return any(w in FRAME_WORDS for w in words) or not in_article and "header" in words and OWN_HEADER.isdisjoint(words)


def is_hidden(found: dict[str, str]) -> bool:
    if "hidden" in found and found["hidden"].lower() != "until-found" or found.get("aria-hidden", "").strip().lower() == "true":
        return True
    declared = [[x.strip().lower() for x in d.partition(":")[::2]] for d in found.get("style", "").split(";")]
    return any(k == "display" and v.startswith("none") or k == "visibility" and v.startswith("hidden") for k, v in declared)


def is_frame(name: str, raw: str, in_article: bool) -> bool:
    """Whether an element belongs to the page's frame rather than to its article."""
    if name in FRAME:
        return True
    if name == "header" and not in_article:
        return True
    if name in ("html", "body", "main") or not raw:
        return False
    found = attributes_of(raw)
    if is_hidden(found) or found.get("role", "").strip().lower() in FRAME_ROLES:
        return True
    return any(names_frame(x, in_article) for x in f"{found.get('class', '')} {found.get('id', '')}".split())


class Walk:
    """Follows a token stream: the open elements, and where each name was last opened."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool]] = []  # name, frame from here, article from here
        self.where: dict[str, list[int]] = defaultdict(list)
        self.frame = self.article = False

    def step(self, kind: str, name: str, raw: str) -> bool:
        """Whether an element was opened that may hold something."""
        if kind == "open":
            if name in CLOSES_P and self.where["p"]:
                self._leave("p", _NOT_P)
            for x in ITEMS.get(name, ()):
                if self.where[x]:
                    self._leave(x, (*LISTS, "tr") if name in ("td", "th") else LISTS)
            if name not in VOID and not raw.rstrip().endswith("/"):
                inside = self.article or name in ("article", "main") or bool(raw) and attributes_of(raw).get("role", "").strip().lower() == "main"
                self.where[name].append(len(self.stack))
                self.frame, self.article = self.frame or is_frame(name, raw, self.article), inside
                self.stack.append((name, self.frame, self.article))
                return True
        elif kind == "close" and self.where.get(name):
            self._leave(name, () if name in ("article", "main", "body", "html") else ("article", "main", "body"))
        return False

    def _leave(self, name: str, barriers: tuple[str, ...]) -> None:
        """Closes the last element of that name, and what it holds, unless a barrier stands in between."""
        k = self.where[name][-1]
        if any(self.where[x] and self.where[x][-1] > k for x in barriers):
            return
        for x, _, _ in self.stack[k:]:
            self.where[x].pop()
        del self.stack[k:]
        _, self.frame, self.article = self.stack[-1] if self.stack else ("", False, False)


_NOT_P = tuple(sorted(BLOCKS - {"p"}))


# ---- expressions -------------------------------------------------------------------------------


class Node:
    """An element, a group ("()") or a text ("#") of an expression.

    many: repeated. pages: how many pages have it. text: a text's literal, or None for a slot. chars and linked:
    characters of its texts, and those of them in links. at: of a page's own expression, the numbers of its blocks.
    """

    __slots__ = ("key", "many", "pages", "text", "chars", "linked", "children", "at")

    def __init__(self, key: str, text: str | None = None, chars: int = 0, linked: int = 0, children: list | None = None, at: list | None = None, many: bool = False, pages: int = 1) -> None:
        self.key, self.text, self.chars, self.linked, self.many, self.pages = key, text, chars, linked, many, pages
        self.children: list[Node] = children or []
        self.at: list[int] = at or []

    def plain(self) -> list:
        return [self.key, int(self.many), self.pages, self.text, self.chars, self.linked, [c.plain() for c in self.children]]

    @staticmethod
    def of(x: list) -> Node:
        return Node(x[0], x[3], x[4], x[5], [Node.of(c) for c in x[6]], None, bool(x[1]), x[2])

    def shape(self) -> tuple:
        return (self.key, tuple(c.shape() for c in self.children))

    def name(self) -> tuple:
        """What two siblings must have alike to fit; of a group, its elements."""
        return (self.key, *[c.key for c in self.children]) if self.key == "()" else (self.key,)

    def expression(self, pages: int = 1) -> str:
        """As text: <p>..</p>, 'literal', # for a slot, (..) for a group, + for repeated and ? for optional."""
        inner = "".join(c.expression(self.pages) for c in self.children)
        if self.key == "#":
            body = "#" if self.text is None else repr(self.text)
        else:
            body = f"({inner})" if self.key in ("()", "(?)") else f"<{self.key}>{inner}</{self.key}>"
        return body + "+" * self.many + "?" * (self.pages < pages)


def merge(a: Node, b: Node, same_page: bool = False) -> Node:
    """The expression that accepts what either does. same_page: both are parts of one page that repeat."""
    a.many = a.many or b.many or same_page
    a.text = a.text if a.text == b.text else None
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
    if same_page:
        a.pages = max(a.pages, b.pages)
        a.at += b.at
    else:
        a.pages, a.at = a.pages + b.pages, []
    if a.children or b.children:
        a.children = align(a.children, b.children, same_page)
    return a


def _score(a: Node, b: Node) -> int:
    """How well two siblings fit each other: 0 if they can't."""
    if a.name() != b.name():
        return 0
    return 2 + 2 * (a.text is not None and a.text == b.text) + ([c.key for c in a.children] == [c.key for c in b.children])


def pairs(a: list[Node], b: list[Node]) -> list[tuple[int, int]]:
    """The best alignment in order of two lists of siblings."""
    if [x.name() for x in a] == [x.name() for x in b]:
        return [(k, k) for k in range(len(a))]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    fit = [[_score(x, y) for y in b] for x in a]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], fit[i][j] and fit[i][j] + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if fit[i][j] and best[i][j] == fit[i][j] + best[i + 1][j + 1]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _general(children: list[Node]) -> list[Node]:
    """Children of one element as one repeated group of optional ones, one for each key."""
    by: dict[str, Node] = {}
    for c in children:
        for x in c.children if c.key in ("()", "(?)") else [c]:
            by[x.key] = merge(by[x.key], x, True) if x.key in by else x
    return [Node("(?)", children=[by[k] for k in sorted(by)], many=True, pages=max((x.pages for x in by.values()), default=1))]


def _grouped(children: list[Node], others: list[Node]) -> list[Node]:
    """A sequence that the other side has as a repeated group is taken as one group too."""
    for group in others:
        keys = [c.key for c in group.children]
        if group.key == "()" and not any(c.key == "()" and [x.key for x in c.children] == keys for c in children):
            for k in range(len(children) - len(keys) + 1):
                if [c.key for c in children[k : k + len(keys)]] == keys:
                    children = [*children[:k], Node("()", children=children[k : k + len(keys)], pages=children[k].pages), *children[k + len(keys) :]]
                    break
    return children


def align(a: list[Node], b: list[Node], same_page: bool = False) -> list[Node]:
    if any(x and x[0].key == "(?)" for x in (a, b)) or max(len(a), len(b)) > WIDE:
        if not a or not b:
            return a or b
        (one,), (two,) = _general(a), _general(b)
        by = {x.key: x for x in one.children}
        for x in two.children:
            by[x.key] = merge(by[x.key], x, same_page) if x.key in by else x
        one.children = [by[k] for k in sorted(by)]
        one.pages = max(one.pages, two.pages) if same_page else one.pages + two.pages
        return [one]
    a, b = _grouped(a, b), _grouped(b, a)
    out: list[Node] = []
    i = j = 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        out += a[i:x] + b[j:y]
        if x < len(a):
            out.append(merge(a[x], b[y], same_page))
        i, j = x + 1, y + 1
    return _general(out) if len(out) > WIDE else out


#: Elements that stand in lists: neighbours of one name are items of one repeated group, whatever is in them.
_ITEM = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())


def _again(a: Node, b: Node) -> Node:
    """Two elements of a group that repeats: the group is repeated, and they only as before."""
    many = a.many or b.many
    a = merge(a, b, True)
    a.many = many
    return a


def fold(children: list[Node]) -> list[Node]:
    """Resolves what repeats among the children of one element of a page."""
    out: list[Node] = []
    for c in children:
        if out and out[-1].key == "()" and c.key in _ITEM and out[-1].children[-1].key == c.key:
            out[-1].children[-1] = merge(out[-1].children[-1], c, True)
            continue
        out.append(c)
        for size in range(1, PERIOD + 1):
            last = out[-size:]
            names = [x.name() for x in last]
            if size > 1 and len(out) > size and out[-size - 1].key == "()" and [(x.key,) for x in out[-size - 1].children] == names:
                group = out[-size - 1]
                group.children = [_again(x, y) for x, y in zip(group.children, last)]
                del out[-size:]
                break
            before = out[-2 * size : -size]
            if len(before) < size or any(x.key == "()" for x in last) or [x.name() for x in before] != names:
                continue
            if size == 1:
                if c.key in _ITEM or before[0].shape() == c.shape():
                    out[-2:] = [merge(before[0], c, True)]
                    break
            elif len(set(names)) > 1:
                out[-2 * size :] = [Node("()", children=[_again(x, y) for x, y in zip(before, last)], many=True)]
                break
    return _general(out) if len(out) > WIDE else out


# ---- pages -------------------------------------------------------------------------------------


class Page:
    """The blocks of a page that roles don't leave out, as (text, inside the article, path), and its expression."""

    def __init__(self, page: str) -> None:
        stream = tokens(page)
        walk, words, linked = Walk(), [], 0
        every: list[tuple[str, bool, str, int]] = []
        root = Node("html")
        open_nodes = [(root, 0)]  # with the depth of the stack at which each began

        def flush() -> None:
            nonlocal linked
            if words:
                block = _SPACE.sub(" ", "".join(words)).strip()
                words.clear()
                if block:
                    open_nodes[-1][0].children.append(Node("#", block, len(block), min(linked, len(block)), at=[len(every)]))
                    every.append((block, inside, "/".join([x[0] for x in walk.stack[:DEPTH]])))
                linked = 0

        def close(depth: int) -> None:
            while len(open_nodes) > 1 and open_nodes[-1][1] >= depth:
                node, _ = open_nodes.pop()
                node.children = fold(node.children)
                if not node.children:
                    open_nodes[-1][0].children.pop()

        inside = False
        for kind, name, value in stream:
            if kind == "text":
                if not walk.frame:
                    text = html.unescape(value)
                    words.append(text)
                    if walk.where["a"]:
                        linked += len(text)
                continue
            block = name in BLOCKS
            if block:
                flush()
            elif name == "br":
                words.append(" ")
            opened = walk.step(kind, name, value)
            place = len(walk.stack) - opened
            close(place)
            if opened and block and not walk.frame and name not in ("html", "body") and len(open_nodes) < DEPTH:
                node = Node(name)
                open_nodes[-1][0].children.append(node)
                open_nodes.append((node, place))
            inside = walk.article
        flush()
        close(0)
        root.children = fold(root.children)
        self.root, self.blocks = root, every
        #: A page with an article keeps only what is inside.
        self.rooted = any(x[1] for x in every)


def block_key(path: str, block: str, inside: bool) -> int:
    """A long for a block at a path; its last bit is set inside the article."""
    digest = hashlib.blake2b(f"{path}\0{block}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True) & ~1 | inside


def infer(pages: list[str]) -> Node:
    """The expression of a host's pages."""
    root = Page(pages[0]).root
    for page in pages[1:]:
        root = merge(root, Page(page).root)
    return root


def frame_blocks(page: Page, wrapper: Node) -> set[int]:
    """Numbers of the page's blocks that its host's expression takes for frame."""
    found: set[int] = set()

    def take(node: Node) -> None:
        found.update(node.at)
        for c in node.children:
            take(c)

    def is_menu(w: Node) -> bool:
        chars, linked = _weights(w)
        return w.many and chars > 0 and linked >= MENU_LINKS * chars

    def visit(own: list[Node], theirs: list[Node], article: bool) -> None:
        if theirs and theirs[0].key == "(?)":
            by = {x.key: x for x in theirs[0].children}
            met = [(c, by[c.key]) for x in own for c in (x.children if x.key in ("()", "(?)") else [x]) if c.key in by]
        else:
            own = _grouped(own, theirs)
            met = [(own[x], theirs[y]) for x, y in pairs(own, theirs)]
        for c, w in met:
            inside = article or w.key in ("article", "main")
            if w.key == "#":
                enough = w.pages >= 3 and w.pages == wrapper.pages if inside else w.pages >= 2
                if w.text is not None and enough:
                    found.update(c.at)
            elif not inside and is_menu(w):
                take(c)
            else:
                visit(c.children, w.children, inside)

    visit(page.root.children, wrapper.children, False)
    return found


def _weights(node: Node) -> tuple[int, int]:
    chars, linked = node.chars, node.linked
    for c in node.children:
        more = _weights(c)
        chars, linked = chars + more[0], linked + more[1]
    return chars, linked


def extract(page: str, wrapper: Node | None = None, shared: frozenset = frozenset()) -> str:
    """Main text of one page: its blocks, one on each line. wrapper: its host's expression; shared: block_key() of
    texts in repeated groups that the host's pages share."""
    read = Page(page)
    kept = [k for k, x in enumerate(read.blocks) if x[1] or not read.rooted]
    frame = frame_blocks(read, wrapper) if wrapper is not None and wrapper.pages > 1 else set()
    if shared:
        frame |= {k for k in kept if block_key(read.blocks[k][2], read.blocks[k][0], read.blocks[k][1]) in shared}
    own = [k for k in kept if k not in frame]
    size = lambda some: sum(len(read.blocks[k][0]) for k in some if read.blocks[k][1])
    if 2 * size(own) <= size(kept):
        own = [k for k in kept if read.blocks[k][1] or k not in frame]
    return "\n".join(read.blocks[k][0] for k in own or kept)


# ---- the corpus --------------------------------------------------------------------------------

LEARNED = "h long, key long, copy long, part long, wrapper string"


def _learn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page a row for each of its texts, and one with no key for the page; for each host the task's expression."""
    part = TaskContext.get().partitionId()
    found: dict[int, Node] = {}

    def rows(hosts: list, keys: list, copies: list, wrappers: list) -> pa.RecordBatch:
        columns = [(hosts, pa.int64()), (keys, pa.int64()), (copies, pa.int64()), ([part] * len(hosts), pa.int64()), (wrappers, pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=["h", "key", "copy", "part", "wrapper"])

    def expressions() -> pa.RecordBatch:
        out = rows(list(found), [None] * len(found), [None] * len(found), [json.dumps(x.plain()) for x in found.values()])
        found.clear()
        return out

    for batch in batches:
        hosts, keys, copies = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = page.as_py() or ""
            copy = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            read = Page(text)
            own = {block_key(path, block, inside) for block, inside, path in read.blocks if inside or not read.rooted}
            hosts += [host] * (len(own) + 1)
            keys += [None, *own]
            copies += [copy] * (len(own) + 1)
            found[host] = merge(found[host], read.root) if host in found else read.root
        yield rows(hosts, keys, copies, [None] * len(hosts))
        if len(found) > 10_000:
            yield expressions()
    yield expressions()


def _fold_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    root = None
    for text in sorted(rows.wrapper):
        node = Node.of(json.loads(text))
        root = node if root is None else merge(root, node)
    return pd.DataFrame({"h": [key[0]], "part": [key[1]], "wrapper": [json.dumps(root.plain())]})


def wrappers(learned: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(h, wrapper): the expression of each host, as JSON, folded from the tasks' in rounds."""
    parts = learned.where(F.col("wrapper").isNotNull()).select("h", "part", "wrapper")
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        most //= fan_in
        parts = parts.withColumn("part", F.floor(F.col("part") / fan_in).cast("long"))
        parts = parts.groupBy("h", "part").applyInPandas(_fold_group, "h long, part long, wrapper string")
        if not most:
            return parts.select("h", "wrapper")


def shared_blocks(learned: DataFrame) -> DataFrame:
    """(shared_h, shared: keys of texts) from all pages. A host has at most ten times as many as its pages have
    blocks on average, or half of all blocks where it has few pages."""
    counted = learned.where(F.col("wrapper").isNull()).select("h", "key", "copy").distinct().groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"))
    # One row for each shared block and host, of any number of pages.
    frequent = counted.where((F.col("n") > 1) | F.col("key").isNull())
    totals = frequent.where(F.col("key").isNull()).select(F.col("h").alias("of_h"), F.col("n").alias("pages"))
    both = frequent.where(F.col("key").isNotNull()).join(totals, F.col("h") == F.col("of_h"))
    inside = F.col("key").bitwiseAND(F.lit(1)) == 1
    enough = F.when(inside, (F.col("n") >= 3) & (F.col("n") == F.col("pages"))).otherwise(10 * F.col("n") >= F.col("pages"))
    return both.where(enough).groupBy(F.col("h").alias("shared_h")).agg(F.sort_array(F.collect_list("key")).alias("shared"))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def _read(batches: Iterator[pa.RecordBatch], held: dict | None) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, h[, wrapper, shared]); held: the last two of each host, where they were broadcast."""
    known: dict[int, tuple] = {}
    for batch in batches:
        texts = []
        for k, (page, host) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
            if host not in known:
                if len(known) > 10_000:
                    known.clear()
                text, shared = held.get(host, (None, None)) if held is not None else (batch.column(4)[k].as_py(), batch.column(5)[k].as_py())
                known[host] = (Node.of(json.loads(text)) if text else None, frozenset(shared or ()))
            texts.append(extract(page.as_py() or "", *known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars. Pages stay where they are, unless the wrappers of all hosts
    are too many to broadcast: then both meet in a join by host, whose hot keys adaptive execution splits."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.xxhash64(host).alias("h"))
    learned = stored(rows.select("h", "html").mapInArrow(_learn_batches, LEARNED))
    known = wrappers(learned).join(shared_blocks(learned), F.col("h") == F.col("shared_h"), "left")
    known = stored(known.select(F.col("h").alias("of_h"), "wrapper", "shared"))
    size = known.agg(F.sum(F.length("wrapper") + 8 * F.coalesce(F.size("shared"), F.lit(0)) + 64)).first()[0] or 0
    if size > broadcast_bytes:
        joined = rows.join(known, F.col("h") == F.col("of_h"), "left")
        return joined.select("page_id", "url", "html", "h", "wrapper", "shared").mapInArrow(lambda batches: _read(batches, None), EXTRACTED)
    held = pages.sparkSession.sparkContext.broadcast({r["of_h"]: (r["wrapper"], r["shared"]) for r in known.collect()})
    return rows.select("page_id", "url", "html", "h").mapInArrow(lambda batches: _read(batches, held.value), EXTRACTED)
