"""Main-text extraction by minimum cut.

A page's text blocks are the nodes of a graph. A logistic classifier over each block's elements, class words, text and
links gives its log-odds of being content, bounded, which become capacities to the two terminals; blocks next to each
other, and blocks with the same parent element, are joined by smoothness edges that weigh more the nearer they are in
the tree. The minimum cut is the cheapest labelling. Blocks whose own evidence outweighs all their edges are settled
first, which changes nothing in the result; a maximum flow labels the rest. ``html_model`` fits the classifier and the
edges' strength.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.html_model import BOUND, fitted
from keystrata.llm.shared import small

# What HTML itself says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title noscript template textarea svg iframe object math canvas select datalist audio video xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that one of the same group closes, and where that search ends.
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"table", "tr"}), "th": ("td th", {"table", "tr"}), "option": ("option", {"select"})}

# Features, whose weights are fitted: elements, roles and words of class and id attributes that may tell of either kind.
BAD_TAGS = frozenset("nav footer aside form menu button dialog search fieldset label".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
        "nav navbar navigation menu menus topbar breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer foot footnav header masthead cookie "
        "cookies consent gdpr notice notices notification alert alerts warning disclaimer popup modal overlay newsletter subscribe subscription signup login "
        "signin register comment comments commentlist respond reply replies disqus discussion feedback share sharing social follow related recommended "
        "recommendations trending popular tags tagcloud pagination pager copyright legal search toolbar paywall teaser outbrain taboola"
    ).split()
)
GOOD_WORDS = frozenset("article content main post entry story body text maincontent articlebody postcontent".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SENTENCE = re.compile(r"[.!?…。]['\")\]»”]*(?:\s|$)")


class Element:
    """An element with what it and those around it tell: how many are ``bad`` by tag, role or word, or ``good``."""

    __slots__ = ("article", "bad_role", "bad_tag", "bad_word", "block", "depth", "good_tag", "good_word", "mixed", "name", "parent")

    def __init__(self, name: str, parent: Element | None, attributes: str):
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        self.block = self if name in BLOCK or parent is None else parent.block
        for flag in ("article", "bad_role", "bad_tag", "bad_word", "good_tag", "good_word", "mixed"):
            setattr(self, flag, getattr(parent, flag) if parent else False)
        words: set[str] = set()
        for m in _ATTR.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words.update(w.lower() for w in _WORDS.findall(value))
            elif key == "role":
                self.bad_role |= value.lower() in BAD_ROLES
            elif key == "hidden":
                self.bad_role |= attributes[m.start() - 1 : m.start()].isspace() and value.lower() != "false"
            elif key == "aria-hidden":
                self.bad_role |= value.lower() == "true"
            else:
                self.bad_role |= bool(_HIDDEN.search(value))
        if name in ("html", "body"):
            return
        tag, good, bad = name in ("article", "main"), bool(words & GOOD_WORDS), bool(words & BAD_WORDS)
        self.bad_tag |= name in BAD_TAGS or name == "header" and not self.article
        self.mixed |= bad and (good or tag or name in HEADINGS) or name == "header" and self.article
        self.bad_word |= bad and not (good or tag or name in HEADINGS)
        self.good_tag |= tag
        self.good_word |= good
        self.article |= name == "article"


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def blocks(html: str) -> list[Block]:
    """The text blocks of a page in order, references decoded and white space made one space."""
    out: list[Block] = []
    at = root = Element("#root", None, "")
    parts: list[str] = []
    linked = links = 0
    # Depths of the open elements of each name, and of all open blocks: whether and where a tag closes needs no walk.
    open_: dict[str, list[int]] = {}
    block_depths: list[int] = []
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(at.block, text, linked))
            parts.clear()
        linked = 0

    def push(element: Element) -> None:
        nonlocal at
        at = element
        open_.setdefault(element.name, []).append(element.depth)
        if element.name in BLOCK:
            block_depths.append(element.depth)

    def pop_to(depth: int) -> None:
        """Closes the element of this depth with all inside it."""
        nonlocal at, links
        while at.depth >= depth:
            links -= at.name == "a"
            open_[at.name].pop()
            if at.name in BLOCK:
                block_depths.pop()
            at = at.parent

    def deepest(names) -> int:
        return max((open_[n][-1] for n in names if open_.get(n)), default=0)

    def close(names, limits=()) -> None:
        """Closes the innermost element of these names unless one of the limits is inside it or is it."""
        found = deepest(names)
        if found and found > deepest(limits):
            flush()
            pop_to(found)

    pos, end = 0, len(html)
    while pos < end:
        lt = html.find("<", pos)
        stop = end if lt < 0 else lt
        if stop > pos:
            piece = unescape(html[pos:stop])
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        if lt < 0:
            break
        follows = html[lt + 1 : lt + 2]
        if follows == "!" or follows == "?":
            mark, skip = ("-->", 4) if html.startswith("<!--", lt) else (">", 2)
            found = html.find(mark, lt + skip)
            if mark == "-->" and html.startswith((">", "->"), lt + 4):
                mark, found = ">", html.find(">", lt + 4)
            pos = end if found < 0 else found + len(mark)
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/"):
            parts.append("<")
            pos = lt + 1
            continue
        m = _TAG.match(html, lt)
        if m is None:
            found = html.find(">", lt)
            if found < 0:
                break
            pos = found + 1
            continue
        pos = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                parts.append(" ")
            elif name == "p" or name in BLOCK:
                flush()
                close((name,), () if name in ("body", "html", "article", "main") else ("article", "main") if name not in ("div", "section", "p") else ())
            else:
                found = deepest((name,))
                if found > (block_depths[-1] if block_depths else 0):
                    pop_to(found)
            continue
        if name in RAW:
            if m[3].endswith("/") and name in ("svg", "math", "object"):
                continue
            found = None if name in unclosed else re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(html, pos)
            if found is None:
                unclosed.add(name)
                pos = end if name in ("script", "style") else pos
            else:
                gt = html.find(">", found.end())
                pos = end if gt < 0 else gt + 1
            parts.append(" ") if name in ("svg", "select", "textarea", "iframe") else None
            continue
        if name in VOID:
            if name in ("hr",):
                flush()
            elif name == "br":
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                names, limits = CLOSES[name]
                close(names.split(), limits)
            if name not in ("td", "th", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot"):
                close(("p",), ("td", "th", "li", "article", "section", "div", "blockquote", "main", "body"))
            elif name == "tr" or name in ("tbody", "thead", "tfoot"):
                close(("p",), ("table",))
        if name == "body" or name == "html":
            flush()
        push(Element(name, at, m[3]))
        links += name == "a"
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block of a page; the last column is one."""
    whole = any((b.element.good_tag or b.element.good_word) and not (b.element.bad_tag or b.element.bad_word or b.element.bad_role) and len(b.text) > 80 for b in found)
    out = np.empty((len(found), 21))
    for i, b in enumerate(found):
        e, n = b.element, len(b.text)
        good = e.good_tag or e.good_word
        out[i] = (
            min(n, 800) ** 0.5 / 10, n < 25, min(1.0, b.linked / n), b.linked > 0.6 * n, bool(_SENTENCE.search(b.text)), min(5, b.text.count(",")) / 5, b.text.startswith(("\xa9", "(c)")),
            e.name == "p", e.name in ("pre", "blockquote"), e.name in HEADINGS, e.name in ("li", "dt", "dd"), e.name in ("td", "th", "caption"),
            e.good_tag, e.good_word, e.bad_tag, e.bad_role, e.bad_word, e.mixed, whole and not good, e.bad_word and e.good_tag, 1.0,
        )
    return out


def evidence(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """The classifier: each block's log-odds of being content by itself, bounded."""
    return np.clip(features(found) @ weights, -BOUND, BOUND)


def distance(a: Element, b: Element) -> int:
    """Steps between two elements of the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges(found: list[Block], strength: float) -> list[tuple[int, int, float]]:
    """Smoothness: each block with the next by their distance in the tree, and with the next of the same parent element."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, strength / (1 + distance(found[i - 1].element, b.element))))
        parent = id(b.element.parent)
        if parent in last:
            out.append((last[parent], i, strength / 2))
        last[parent] = i
    return out


def labels(found: list[Block], weights: np.ndarray, strength: float) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    return min_cut(evidence(found, weights).tolist(), edges(found, strength)) if found else []


def min_cut(unary: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (true: content) that pays least: -u for a false label of u > 0, u for one of u < 0, w for each cut edge."""
    n, u = len(unary), list(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in links:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(u[i]) < weight[i]:
            continue
        label[i] = u[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                u[j] += w if label[i] else -w
                weight[j] -= w
                todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow([u[i] for i in left], left, near, label), strict=True):
            label[i] = content
    return [bool(x) for x in label]


def _max_flow(u: list[float], left: list[int], near: list[dict[int, float]], label: list[bool | None]) -> list[bool]:
    """Dinic's algorithm; nodes that the source still reaches are content."""
    at = {i: k for k, i in enumerate(left)}
    n = len(left)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def add(a: int, b: int, there: float, back: float) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            graph[x].append(len(head))
            head.append(y)
            room.append(c)

    for k, i in enumerate(left):
        if u[k] > 0:
            add(source, k, u[k], 0.0)
        elif u[k] < 0:
            add(k, sink, -u[k], 0.0)
        for j, w in near[i].items():
            if j > i and label[j] is None:
                add(k, at[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for e in graph[x]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[x] + 1
                    queue.append(head[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        arc = [0] * (n + 2)
        path: list[int] = []
        x = source
        while True:
            if x == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= tiny)
                x = head[path[cut] ^ 1]
                del path[cut:]
                continue
            while arc[x] < len(graph[x]):
                e = graph[x][arc[x]]
                if room[e] > tiny and level[head[e]] == level[x] + 1:
                    break
                arc[x] += 1
            if arc[x] < len(graph[x]):
                path.append(graph[x][arc[x]])
                x = head[path[-1]]
            elif x == source:
                break
            else:
                level[x] = -1
                x = head[path.pop() ^ 1]


def extract(html: str, model: tuple[np.ndarray, float] | None = None) -> str:
    """The main text: its blocks in page order, joined by an empty line."""
    weights, strength = model or fitted()
    found = blocks(html)
    return "\n\n".join(b.text for b, k in zip(found, labels(found, weights, strength), strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; a null or empty html gives an empty text.

    Every row gives one row, repeated and null ids included; other columns play no part.
    """

    model = fitted()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = [extract(h, model) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(apply, "page_id bigint, url string, text string, n_chars bigint")
