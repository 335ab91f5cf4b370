"""Main-text extraction by wrapper induction.

Simple tree matching aligns only nodes of equal labels from the root down, so a constant node is a text
that recurs at one path of labels. On every host, what more than TEMPLATE_SHARE of its different pages
have there, and LEAST_PAGES of them at least, is template; all pages count, and each item of a list by
itself. Pages are different if a text that holds a letter differs: copies, also with other counters or
dates, count once. Of a few of the host's pages the DOM trees, without template, are aligned by simple
tree matching; the deepest element that holds the varying text is the host's region. A page's main text
is what stands in its article or main element, which the region may narrow, else in the region, else on
the whole page (see ``extract``), without template and without parts that are never main text (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles).

A part that a class or id tells to stand beside the main text is judged by what it holds (see ``settle``),
so no name blanks a page.

Scale: text is counted as 64-bit hashes of path and text, partly before the shuffle; a hot host is
split over its pages, then over its hashes. A host has at most (texts a page / TEMPLATE_SHARE) template
texts. The region needs at most ``REFERENCES`` pages, chosen by an aggregate that keeps one page for
each of so many hash classes. Wrappers have no bound of their own; they are broadcast up to a counted
number of bytes, else joined by host. Trees that are aligned join neighbouring siblings of one label, and
subtrees of one shape are compared once; siblings between an equal beginning and end are aligned row by
row in memory that grows with their number. Trees of any depth and number of nodes are whole trees.

Null and empty html gives an empty text. Hosts are compared in lower case; a null or hostless url has
the empty host. Equal rows give equal rows. Other columns are ignored. An empty table gives no rows. A
very long page costs one task its tree.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, slices

#: Pages of a host that are aligned.
REFERENCES = 4
#: More than this share of a host's different pages have a text of its template, and so many of them at least: two may be near copies.
TEMPLATE_SHARE, LEAST_PAGES = 0.5, 3
#: Bytes of wrappers that may be broadcast.
BROADCAST_BYTES = 40_000_000
#: Cells of the table by which two rows of siblings are aligned at once; longer rows are halved.
TABLE_CELLS = 1 << 22

# The HTML standard's element groups, and names that sites give to parts beside the main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark nobr output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NEVER_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video head title nav header footer aside form button select textarea input option menu dialog".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
NEVER_NAMED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar".split())
COMMENT_NAMED = frozenset("comment commentlist comments discussion disqus replies respond responses".split())
STATES = frozenset("has have hide is no not show with without".split())
NEVER_NAMED_ALONE = NEVER_NAMED | frozenset("alert discussion header login masthead page-header replies respond responses search site-header skip widget widgets".split())
# End of fixed values.

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|=(?!\s*[\"']))*)>?|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
HEADLINE = re.compile("h[1-3]$")


#: What a name tells of an element: by a piece of it, or by the whole name.
PART, COMMENT_PART, WHOLE, COMMENT_WHOLE = 1, 2, 3, 4
COMMENTS = (COMMENT_PART, COMMENT_WHOLE)


@dataclass
class Node:
    """An element of block level: label, own text by place among the children, children, whether it is never main text."""

    label: str
    tag: str
    never: bool = False
    parts: list = field(default_factory=list)  # str or Node, in page order
    many: bool = False  # stands for several equal siblings
    beside: int = 0  # above 0 if a name tells that it stands beside the main text

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def own(self) -> str:
        return _SPACE.sub(" ", "".join(p for p in self.parts if isinstance(p, str))).strip()


@lru_cache(1 << 14)
def _named(attributes: str) -> tuple[str, int, bool]:
    """The class and id part of a label, whether a name (or a part of one) is of something beside the main text, and whether role or state hide it.

    A name with a word such as "has" or "no" tells of a state, not of what the element is.
    """
    marks, beside, hidden = [], 0, False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = value.split()
            marks += [w for w in words if not re.search(r"\d", w)]
            for w in words:
                parts = re.split(r"[-_]+", w)
                if w in COMMENT_NAMED:
                    beside = COMMENT_WHOLE
                elif w in NEVER_NAMED_ALONE:
                    beside = max(beside, WHOLE)
                elif any(p in NEVER_NAMED for p in parts) and not STATES & set(parts):
                    beside = max(beside, COMMENT_PART if COMMENT_NAMED & set(parts) else PART)
        elif name == "role":
            hidden |= value in NEVER_ROLE
        elif name == "hidden" or value == "true":
            hidden = True
    return "".join(f".{w}" for w in sorted(set(marks))[:3]), beside, hidden


class _Open:
    """The open elements; an inline element lies within the block that is open when it begins."""

    def __init__(self) -> None:
        self.root = Node("#", "#")
        self.stack, self.count = [self.root], Counter()
        self.inline: list[tuple[str, int, bool]] = []  # tag, open elements around it, whether it is a node itself
        self.inline_count = Counter()

    def push(self, node: Node) -> None:
        self.stack[-1].parts.append(node)
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, size: int) -> None:
        for node in self.stack[size:]:
            self.count[node.tag] -= 1
        del self.stack[size:]
        while self.inline and self.inline[-1][1] > size:
            self.inline_count[self.inline.pop()[0]] -= 1

    def close(self, tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """End the innermost element of ``tags``, and all within it, unless one of ``within`` lies around them."""
        count = self.count
        for t in tags:
            if count[t]:
                break
        else:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in within:
                return
            if self.stack[i].tag in tags:
                return self.cut(i)

    def begin_inline(self, tag: str, node: Node | None) -> None:
        self.inline.append((tag, len(self.stack), node is not None))
        self.inline_count[tag] += 1
        if node:
            self.push(node)

    def end_inline(self, tag: str) -> None:
        """End the innermost inline element of this tag, and those within it."""
        name = None
        while self.inline_count[tag] and name != tag:
            name, size, is_node = self.inline.pop()
            self.inline_count[name] -= 1
            if is_node:
                self.cut(size)


def parse(html: str) -> Node:
    """The tree of block-level elements; inline elements leave their text only, unless hidden or told to stand beside. Unclosed and crossed tags are borne."""
    opened = _Open()
    at = 0

    def text(raw: str) -> None:
        if raw:
            opened.stack[-1].parts.append(unescape(raw))

    while True:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            return settle(opened.root)
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                opened.end_inline(tag)
            else:
                opened.close((tag,))
            continue
        if tag == "br" or tag == "hr":
            opened.stack[-1].parts.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in VOID:
            continue
        marks, beside, hidden = _named(m[3]) if m[3] else ("", 0, False)
        if tag in INLINE:
            told = hidden or tag == "span" and beside > 0
            opened.begin_inline(tag, Node("span" + marks, "span", hidden, beside=beside) if told else None)
            continue
        if tag in CLOSES_P:
            opened.close(("p",), ("table", "button"))
        if tag == "li":
            opened.close(("li",), ("ul", "ol"))
        elif tag in ("dt", "dd"):
            opened.close(("dt", "dd"), ("dl",))
        elif tag in ("tr", "td", "th"):
            opened.close(("td", "th") if tag != "tr" else ("tr",), ("table",) if tag == "tr" else ("tr",))
        if tag in ("html", "body", "main"):
            beside, hidden = 0, False
        elif tag == "article" and beside < WHOLE:
            beside = 0  # a page's article may be styled by what stands beside it; only a whole name counts
        opened.push(Node(tag + marks, tag, tag in NEVER_TEXT or hidden, beside=beside))


def settle(root: Node) -> Node:
    """Decide which told parts stand beside the main text.

    A part with all of the page's article and main elements isn't beside them, unless it holds comments. A part
    of which only a piece of a name tells isn't if it has half of the page's text. All others are.
    """
    order = [root]
    for node in order:
        if not node.never:
            order.extend(node.children)
    if not any(n.beside for n in order):
        return root
    held, articles = {}, {}
    for node in reversed(order):
        if node.never:
            held[id(node)] = articles[id(node)] = 0
            continue
        below = node.children
        held[id(node)] = sum(len(p.strip()) for p in node.parts if isinstance(p, str)) + sum(held[id(c)] for c in below if c.beside not in COMMENTS)
        articles[id(node)] = sum(articles[id(c)] for c in below if c.beside not in COMMENTS) + (node.tag in ("article", "main") and not node.beside)
    size, count = held[id(root)], articles[id(root)]
    for node in order:
        if node.beside and not node.never:
            holds = count and articles[id(node)] == count or node.beside == PART and not count and 2 * held[id(node)] >= size
            node.never = node.beside in COMMENTS or not holds
    return root


def merged(root: Node) -> Node:
    """A copy in which neighbouring siblings of one label are one node."""
    top = Node(root.label, root.tag, root.never)
    todo = [(root, top)]
    while todo:
        node, out = todo.pop()
        out.many = node.many
        for part in node.parts:
            last = out.parts[-1] if out.parts and isinstance(out.parts[-1], Node) else None
            if isinstance(part, str):
                if last is None or part.strip():
                    out.parts.append(part)
            elif last is not None and last.label == part.label:
                last.many = True
                last.parts.append(" " + _all_text(part))
            else:
                copy = Node(part.label, part.tag, part.never)
                out.parts.append(copy)
                todo.append((part, copy))
    return top


def _all_text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(" ")
            todo.extend(p for p in reversed(x.parts) if isinstance(p, str) or not p.never)
    return "".join(out)


class _Shapes:
    """Numbers for trees of equal labels, and the sizes of the largest matches of two such."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.of: list[tuple[str, tuple[int, ...]]] = []
        self.size: dict[tuple[int, int], int] = {}

    def add(self, root: Node) -> dict[int, int]:
        """The shape of each node of a tree, by the node's identity."""
        order, out = [root], {}
        for node in order:
            order.extend(node.children)
        for node in reversed(order):
            key = (node.label, tuple(out[id(c)] for c in node.children))
            if key not in self.number:
                self.number[key] = len(self.of)
                self.of.append(key)
            out[id(node)] = self.number[key]
        return out

    def match(self, a: int, b: int) -> int:
        """The size of the largest order-keeping match of two shapes; those below are done first."""
        todo = [(a, b)]
        while todo:
            pair = todo[-1]
            if pair in self.size:
                todo.pop()
                continue
            xs, ys = self.of[pair[0]][1], self.of[pair[1]][1]
            if self.of[pair[0]][0] != self.of[pair[1]][0]:
                self.size[pair] = 0
                continue
            labelled: dict[str, list[int]] = {}
            for y in set(ys):
                labelled.setdefault(self.of[y][0], []).append(y)
            below = [(x, y) for x in set(xs) for y in labelled.get(self.of[x][0], ()) if (x, y) not in self.size]
            if below:
                todo.extend(below)
            else:
                self.size[pair] = 1 + sum(self.size.get((xs[i], ys[j]), 0) for i, j in self.align(xs, ys))
        return self.size[a, b]

    def align(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[tuple[int, int]]:
        """The places of an order-keeping match of two rows of shapes that is largest. Equal beginnings and ends match as they are."""
        first = 0
        while first < min(len(xs), len(ys)) and xs[first] == ys[first]:
            first += 1
        last = 0
        while last < min(len(xs), len(ys)) - first and xs[-1 - last] == ys[-1 - last]:
            last += 1
        pairs = [(i, i) for i in range(first)] + [(len(xs) - 1 - i, len(ys) - 1 - i) for i in range(last)]
        todo = [(first, len(xs) - last, first, len(ys) - last)]
        rows: dict[int, np.ndarray] = {}
        inner = np.array(ys[first : len(ys) - last], np.int64)
        kinds, at = np.unique(inner, return_inverse=True)

        def weights(i: int) -> np.ndarray:
            if xs[i] not in rows:
                rows[xs[i]] = np.array([self.size.get((xs[i], int(k)), 0) for k in kinds], np.int64)
            return rows[xs[i]][at]

        def step(before: np.ndarray, w: np.ndarray) -> np.ndarray:
            out = before.copy()
            np.maximum(out[1:], before[:-1] + w, out=out[1:])
            return np.maximum.accumulate(out)

        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            a, b = j0 - first, j1 - first
            if i1 - i0 > 1 and (i1 - i0) * (j1 - j0) > TABLE_CELLS:
                mid, ahead, behind = (i0 + i1) // 2, np.zeros(b - a + 1, np.int64), np.zeros(b - a + 1, np.int64)
                for i in range(i0, mid):
                    ahead = step(ahead, weights(i)[a:b])
                for i in range(i1 - 1, mid - 1, -1):
                    behind = step(behind, weights(i)[a:b][::-1])
                cut = j0 + int((ahead + behind[::-1]).argmax())
                todo += [(i0, mid, j0, cut), (mid, i1, cut, j1)]
                continue
            best = [np.zeros(b - a + 1, np.int64)]
            for i in range(i0, i1):
                best.append(step(best[-1], weights(i)[a:b]))
            i, j = i1 - i0, b - a
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i0 + i, j0 + j))
        return pairs


def tree_match(a: Node, b: Node, shapes: _Shapes | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest order-keeping match of equal labels, and its pairs."""
    shapes = shapes or _Shapes()
    known = shapes.add(a) | shapes.add(b)
    size = shapes.match(known[id(a)], known[id(b)])
    pairs, todo = [], [(a, b)] if size else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        xs, ys = x.children, y.children
        rows = [tuple(known[id(c)] for c in row) for row in (xs, ys)]
        for p in {(p, q) for p in set(rows[0]) for q in set(rows[1]) if shapes.of[p][0] == shapes.of[q][0]}:
            shapes.match(*p)
        todo.extend((xs[i], ys[j]) for i, j in shapes.align(*rows))
    return size, pairs


def _without(root: Node, marks: set[int]) -> Node:
    """``root``, with the text of its innermost elements gone where it is marked."""
    todo = [(root, ROOT)] if marks else []
    while todo:
        node, path = todo.pop()
        below = node.children
        if not below and mark(path, node.own()) in marks:
            node.parts = []
        todo.extend((c, _path_hash(path, c.label, _PATHS)) for c in below)
    return root


def induce(pages: list[str], marks: set[int] | None = None) -> dict:
    """The wrapper of pages of one host: ``region`` (labels from the root) and ``template``, the path hashes of its constant single nodes.

    The region is the deepest element that holds four fifths of a page's varying text, or the one around
    it that adds nothing but a varying headline; of the pages' regions, the one that most pages have, so
    an odd page decides nothing. Text of ``marks`` is known to be template. With fewer than two different
    pages, or none that vary, nothing is known and both are empty.
    """
    trees = [merged(_without(parse(p), marks or set())) for p in dict.fromkeys(pages)]
    if len(trees) < 2:
        return {"region": [], "template": []}
    texts: dict[int, list[str]] = {}
    shapes = _Shapes()
    for i, one in enumerate(trees):
        for other in trees[i + 1 :]:
            for x, y in tree_match(one, other, shapes)[1]:
                for own, its in ((x, y), (y, x)):
                    texts.setdefault(id(own), [own.own()]).append(its.own())
    found, paths = zip(*(_region(t, texts, len(trees)) for t in trees), strict=True)
    region, template = max(found, key=lambda f: sum(path_hash(f[0]) in p for p in paths) if f[0] else 0)
    return {"region": region, "template": template}


def _region(tree: Node, texts: dict[int, list[str]], trees: int) -> tuple[tuple[list[str], list[int]], set[int]]:
    """The region of one of the aligned trees with the path hashes of its constant nodes, and all path hashes; ``texts`` has each node's own and all matched texts."""
    weight, headed, constants = Counter(), set(), []
    order: list[tuple[Node, int, int, int, bool]] = [(tree, -1, 1, ROOT, tree.never)]  # node, place of its parent, level, path, never
    for at, (node, _, level, path, never) in enumerate(order):
        order.extend((c, at, level + 1, _path_hash(path, c.label, _PATHS), never or c.never) for c in node.children)
    held_by: dict[int, int] = {}
    for at in range(len(order) - 1, -1, -1):
        node, _, _, path, never = order[at]
        seen = texts.get(id(node), [])
        constant = len(seen) == trees and len(set(seen)) == 1 and seen[0] and not node.many and not node.children
        if constant and not never:
            constants.append(at)
        held = 0 if never or constant else len(node.own())
        parts = [(c, held_by[id(c)]) for c in node.children]
        if not held and sum(n > 0 and not HEADLINE.match(c.tag) for c, n in parts) == 1 and any(n > 0 and HEADLINE.match(c.tag) for c, n in parts):
            headed.add(path)
        held_by[id(node)] = held = held + sum(n for _, n in parts)
        weight[path] = max(weight[path], held)
    total, known = held_by[id(tree)], {path for _, _, _, path, _ in order}
    deepest = max((at for at, (node, _, _, path, _) in enumerate(order) if total and 5 * weight[path] >= 4 * total and node.tag not in ("p", "li")), key=lambda at: order[at][2], default=-1)
    if deepest < 0:
        return ([], []), known
    if order[deepest][1] >= 0 and order[order[deepest][1]][3] in headed:
        deepest = order[deepest][1]
    top, labels, at = order[deepest][3], [], deepest
    while at >= 0:
        labels.append(order[at][0].label)
        at = order[at][1]
    inside: list[bool] = []
    for _, parent, _, path, _ in order:
        inside.append(path == top or parent >= 0 and inside[parent])
    return (labels[::-1], [order[at][3] for at in constants if inside[at]]), known


def _path_hash(above: int, label: str, known: dict[tuple[int, str], int]) -> int:
    """The hash of a path of labels, from that of the path above; the same on every worker."""
    key = (above, label)
    if key not in known:
        if len(known) > 100_000:
            known.clear()
        known[key] = xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), above)
    return known[key]


_PATHS: dict[tuple[int, str], int] = {}
ROOT = _path_hash(0, "#", _PATHS)


def path_hash(labels: Iterable[str]) -> int:
    at = 0
    for label in labels:
        at = _path_hash(at, label, _PATHS)
    return at


def _runs(top: Node, path: int) -> Iterator[tuple[int, str]]:
    """(path hash, text) of each unbroken run of text below ``top``, without parts that are never main text."""
    run: list[str] = []
    todo: list[tuple] = [(p, path) for p in reversed(top.parts)]
    at = path

    def block() -> str:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        return text

    while todo:
        part, here = todo.pop()
        if isinstance(part, str):
            run.append(part)
            continue
        if part is None or part.tag != "span":
            text = block()
            if text:
                yield at, text
            at = here if part is None else at
        if part is None or part.never:
            continue
        if part.tag == "span":
            todo.extend((p, here) for p in reversed(part.parts))
        else:
            todo.append((None, at))
            at = _path_hash(here, part.label, _PATHS)
            todo.extend((p, at) for p in reversed(part.parts))
    text = block()
    if text:
        yield at, text


def mark(path: int, text: str) -> int:
    """A signed 64-bit hash of a run of text at its path."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), path)
    return h - (1 << 64) if h >> 63 else h


def marks_of(html: str) -> dict[int, bool]:
    """The marks of all text of a page that may be main text, in page order, and whether it holds a letter."""
    return {mark(path, text): any(map(str.isalpha, text)) for path, text in _runs(parse(html), ROOT)}


def extract(html: str, wrapper: dict | None = None) -> str:
    """The main text of a page: that of its outermost article or main elements, else of the region, else of the whole page.

    Where the region lies in an article or main element and holds four fifths of its text, it stands for it.
    Template is left out everywhere, also in articles, unless nothing else is left.
    ``wrapper`` has ``region`` and ``template`` as from ``induce``, and perhaps ``marks``, the template's marks.
    """
    if not html:
        return ""
    root = parse(html)
    known = wrapper or {"region": [], "template": []}
    region = path_hash(known["region"]) if known["region"] else None
    template, marks = set(known["template"]), known.get("marks", ())
    semantic: list[tuple[Node, int]] = []
    in_region: list[tuple[Node, int]] = []
    inside: list[tuple[Node, int]] = []
    todo = [(root, ROOT, False)]
    while todo:
        node, path, within = todo.pop()
        if node.never:
            continue
        if not within and node.tag in ("article", "main"):
            semantic.append((node, path))
            within = True
        if region is not None and path == region:
            (inside if within else in_region).append((node, path))
        if not within or region is not None:
            todo.extend((c, _path_hash(path, c.label, _PATHS), within) for c in reversed(node.children))

    def texts(tops: list[tuple[Node, int]]) -> tuple[list[str], list[str]]:
        every, own = [], []
        for top, path in tops:
            for at, text in _runs(top, path):
                every.append(text)
                if at not in template and (not marks or mark(at, text) not in marks):
                    own.append(text)
        return every, own

    every, own = texts(semantic or in_region or [(root, ROOT)])
    if semantic and inside:
        part = texts(inside)[1]
        if 5 * sum(map(len, part)) >= 4 * sum(map(len, own)):
            own = part
    return " ".join(own or every)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def template_marks(pages: DataFrame) -> DataFrame:
    """(host, total, marks): the number of a host's pages of different text, and the marks of its template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                held = [marks_of(h) for h in batch.column("html").to_pylist()]
                ids = [xxhash.xxh3_64_intdigest(b"".join(m.to_bytes(8, "little", signed=True) for m, lettered in page.items() if lettered)) for page in held]
                yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([i - (1 << 64) if i >> 63 else i for i in ids], pa.int64()), pa.array([list(page) for page in held], pa.list_(pa.int64()))], ["host", "page", "marks"])

    read = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, page long, marks array<long>")
    different = checkpointed(read.where(F.size("marks") > 0).dropDuplicates(["host", "page"]))
    totals = different.groupBy("host").agg(F.count("*").alias("total"))
    counts = different.select("host", F.explode("marks").alias("mark")).groupBy("host", "mark").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    found = counts.join(totals, "host").where(F.col("pages") > TEMPLATE_SHARE * F.col("total")).groupBy("host").agg(F.collect_list("mark").alias("marks"))
    return totals.join(found, "host", "left")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, marks): of each host the region and template paths as JSON, and the marks of its template; hosts of which nothing is known are left out."""
    known = checkpointed(template_marks(pages))
    chosen = pages.where("html is not null").select(host_of(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("h")).groupBy("host", F.pmod(F.shiftright("h", 8), F.lit(REFERENCES)).alias("slot")).agg(F.min_by("html", "h").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, texts, marks in zip(*(batch.column(c).to_pylist() for c in ("host", "pages", "marks")), strict=True):
                wrapper = induce(texts, set(marks or ())) | {"template": []}  # of constant nodes, those count that all pages confirm
                if wrapper["region"] or marks:
                    rows.append((host, json.dumps(wrapper), marks or []))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], ["host", "wrapper", "marks"])

    # At most REFERENCES pages are collected for each host.
    collected = chosen.groupBy("host").agg(F.array_sort(F.collect_list("html")).alias("pages"))
    return collected.join(known, "host").select("host", "pages", "marks").mapInArrow(run, "host string, wrapper string, marks array<long>")


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    known = checkpointed(wrappers(pages))
    size = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 8 * F.size("marks")), F.lit(0))).first()[0]
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(broadcast_if_small(known, size, BROADCAST_BYTES), "host", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "wrapper", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, dict] = {}
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = []
                for i, (html, host) in enumerate(zip(batch.column("html").to_pylist(), batch.column("host").to_pylist(), strict=True)):
                    if host not in read:
                        if len(read) > 1000:
                            read.clear()
                        wrapper = batch.column("wrapper")[i].as_py()
                        read[host] = json.loads(wrapper) | {"marks": set(batch.column("marks")[i].as_py())} if wrapper else {"region": [], "template": []}
                    texts.append(extract(html or "", read[host]))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
