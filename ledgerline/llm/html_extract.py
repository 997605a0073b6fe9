"""Main text of web pages by tree scoring.

The page becomes a tree in which block elements hold text blocks. Boilerplate subtrees
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments of readers)
are cut by element name and role, and by class and id: when all words of a class or id name
boilerplate (``ad``, ``cookie-notice``, ``main-nav``), unless it is the id of a title (on a
heading, or the heading below says the same); when the name has another meaning too
(``notice``, ``related``), only if the subtree is short or mostly links; when one word of a
longer name does (``related-work``), only if it is mostly links or a short label. Inside an
``article`` or ``main`` such names cut only what is mostly links, whatever its size; an article's own
header stays. Headings and paragraphs stay when the name has another meaning too. Each remaining block passes
points for its length and commas to its ancestors, halved at each step up; a node's score
is discounted by its share of link text. The best node is the main container, widened to
the ``article`` or ``main`` around it. Beside it, and beside each element around it up to
``main`` or ``body``, headings, paragraphs, lists, tables, figures, sections and bare text stay
when at most half of their text is in links, other elements (and further articles) when they
score well themselves too. Where such another element stays, the parent (but not ``body``)
is the container of both, and its elements with few links all stay. All in page order.

Blocks are joined by two line feeds. Character references are decoded, white space inside
a block becomes one space.

A quote opens an attribute's value only after ``=``, and only if it is closed somewhere; a tag ends
at the next ``>`` outside values. Time is proportional to the page, however deep or broken.

Defined results: null, empty or text-free html gives an empty text; broken markup is read as far
as it goes (unclosed and stray tags, a missing body). An empty table gives an empty
result. The columns named in ``carry`` come along; a result column wins over a carried one
of its name.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import carried, map_arrow

# Element names of HTML by their part here.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "annotation", "annotation-xml", "noframes", "xmp")
CUT = frozenset("nav header footer aside form button select option input fieldset dialog menu head object audio video canvas".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
#: words of class and id, split at anything but letters and digits, and at inner capitals
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies"
    " consent disqus discussion footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice pager pagination"
    " popup promo promoted promotion recommended related remark replies reply respond share sharing sidebar signup social sponsor"
    " sponsored subscribe subscription toolbar widget".split()
)
#: of these, words that a section or paragraph of the text may have as its name too
AMBIGUOUS = frozenset(
    "advertising consent discussion navigation notice promoted promotion recommended related remark share sharing social sponsor subscription".split()
)
#: their sections go whatever the heading says
READERS = frozenset("ad ads adv advert adverts advertisement comment comments commentlist disqus".split())
#: words that only say where or what kind of box it is
FILLER = frozenset(
    "top bottom left right main site page global primary secondary inner outer box list bar area wrap wrapper container block section"
    " item items link links button buttons unit slot content js".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: elements of running text
TEXT = HEADINGS | frozenset("p pre blockquote ul ol li dl dt dd table figure section hgroup".split())
CLOSES_P = BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html"}
#: a start tag closes an open element of these names up to the nearest of the second ones
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SIBLING_SHARE = 0.2
LINK_LIMIT = 0.5
#: characters of a short subtree with an ambiguous name, and of a label
SHORT, LABEL = 200, 80

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)", re.S)
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
SPACE = re.compile(r"\s*")
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+))|([^\s=/]+)")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """An element. ``items``: text pieces (text, inside a link) and child block nodes in page order."""

    __slots__ = ("name", "parent", "cut", "suspect", "items", "points", "chars", "linked")

    def __init__(self, name: str, parent: Node | None, cut: bool = False, suspect: Sequence[tuple[str, bool, list[str]]] = ()):
        self.name, self.parent, self.cut = name, parent, cut
        self.suspect = suspect
        self.items: list[tuple[str, bool] | Node] = []
        self.points = self.chars = self.linked = 0.0

    def score(self) -> float:
        return self.points * (1 - self.linked / self.chars) if self.chars else 0.0


def _named(token: str, is_id: bool) -> tuple[str, bool, list[str]] | None:
    """How a class or id speaks of boilerplate: (``exact``, ``readers``, ``ambiguous`` or ``part``,
    whether it is an id, its words), if it does."""
    words = [w.lower() for w in NAME_WORD.findall(token)]
    said = [w for w in words if w in CUT_WORDS]
    joined = "".join(words)
    if joined in CUT_WORDS:
        said = [joined]
    elif not said:
        return None
    elif any(w not in CUT_WORDS and w not in FILLER and not w.isdigit() for w in words):
        return "part", is_id, words
    if any(w in READERS for w in said):
        return "readers", is_id, words
    alone = len(said) == 1 and said[0] in AMBIGUOUS  # two such words together have no other meaning
    return "ambiguous" if alone else "exact", is_id, words


def _is_cut(name: str, attrs: str) -> tuple[bool, Sequence[tuple[str, bool, list[str]]]]:
    """Whether an element is cut whatever is in it, and the names that may cut it."""
    if name in CUT:
        return True, ()
    if not attrs or attrs.isspace():
        return False, ()
    found = {(m[1] or m[5] or "").lower(): htmllib.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True, ()
    if "display:none" in "".join(found.get("style", "").lower().split()):
        return True, ()
    if found.get("role", "").lower() in CUT_ROLES:
        return True, ()
    if name in ("body", "html", "article", "main"):  # these classes often speak of the whole page
        return False, ()
    names = [_named(t, False) for t in found.get("class", "").split()] + [_named(t, True) for t in found.get("id", "").split()]
    names = [x for x in names if x]
    if name in HEADINGS:  # their ids are made from titles
        return any(kind in ("exact", "readers") and not is_id for kind, is_id, _ in names), ()
    if name not in BLOCK:
        sure = ("exact", "readers", "ambiguous") if name == "a" else ("exact", "readers")
        return any(kind in sure for kind, _, _ in names), ()
    if any(kind == "readers" or (kind == "exact" and not is_id) for kind, is_id, _ in names):
        return True, ()
    return False, names


def _goes(node: Node, title: list[str], prose: bool, inside: bool) -> bool:
    """Whether one of the names of a suspected node cuts it, from what is in it; ``inside``: of an article or main."""
    if node.linked > LINK_LIMIT * node.chars:
        return True
    for kind, is_id, words in node.suspect:
        if is_id and set(words) <= set(title):
            continue
        if kind == "exact":
            return True
        if inside:  # a name with another meaning is no reason to drop text of the article
            continue
        if kind == "ambiguous" and node.name not in ("p", "pre", "blockquote") and node.chars < SHORT:
            return True
        if kind == "part" and node.chars < LABEL and not prose and node.name not in ("p", "pre", "blockquote", "li"):
            return True
    return False


def _judge(root: Node) -> None:
    """Cuts the suspected nodes that go, inner ones first."""
    order, stack = [], [root]
    inside: set[Node] = set()
    while stack:
        node = stack.pop()
        order.append(node)
        if node.name in ("article", "main") or node.parent in inside:
            inside.add(node)
        stack.extend(x for x in reversed(node.items) if isinstance(x, Node) and not x.cut)
    size: dict[Node, list[float]] = {}
    titles: dict[Node, list[str]] = {}
    prose: set[Node] = set()
    for node in reversed(order):
        chars, linked = size.get(node, (0.0, 0.0))
        text = []
        for run in _runs(node):
            if not isinstance(run, Node):
                chars, linked = chars + run[1], linked + run[2]
                text.append(run[0])
        if node.name in HEADINGS and text:
            titles[node] = [w.lower() for w in NAME_WORD.findall(" ".join(text))]
        if chars and (node.name in HEADINGS or node.name in ("p", "pre", "blockquote", "li", "table")):
            prose.add(node)
        if node.suspect:
            node.chars, node.linked = chars, linked
            node.cut = _goes(node, titles.get(node, []), node in prose, node in inside)
            node.chars = node.linked = 0.0
        if node.parent is not None and not node.cut:
            size[node.parent] = [a + b for a, b in zip(size.get(node.parent, (0.0, 0.0)), (chars, linked))]
            if node in titles:  # an earlier one comes later here
                titles[node.parent] = titles[node]
            if node in prose:
                prose.add(node.parent)


class _Tags:
    """The tags of a page in order: (start, end, name, attributes, whether it is an end tag)."""

    def __init__(self, page: str):
        self.page, self.none_after = page, {'"': len(page), "'": len(page)}

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag. A quote opens a value only after ``=``, and only if it is closed."""
        page = self.page
        stop = page.find(">", at)
        while stop >= 0:
            equals = page.find("=", at, stop)
            if equals < 0:
                return stop
            at = SPACE.match(page, equals + 1).end()
            quote = page[at : at + 1]
            if quote in self.none_after and at < self.none_after[quote]:
                closed = page.find(quote, at + 1)
                if closed < 0:
                    self.none_after[quote] = at
                else:
                    at = closed + 1
            if at > stop:
                stop = page.find(">", at)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, str, bool]]:
        page, at = self.page, 0
        while m := TOKEN.search(page, at):
            at, name = m.end(), m["name"]
            if not name:
                yield m.start(), at, "", "", False
                continue
            end = self._end(at)
            if end < 0:  # no tag from here on has an end
                return
            attrs, name = page[at:end], name.lower()
            at = end + 1
            if name in RAW_END and not m["end"]:
                closed = RAW_END[name].search(page, at)
                at = closed.end() if closed else len(page)
                name = ""
            yield m.start(), at, name, attrs, bool(m["end"])


def parse(page: str) -> Node:
    """The tree of block nodes; inline elements only add their text to it."""
    root = Node("html", None)
    open_: list[tuple[str, Node]] = [("html", root)]  # (element, the block node its text goes to)
    places: dict[str, list[int]] = defaultdict(list)  # element -> where in ``open_`` it is
    blocks: list[int] = []  # where the block elements are
    links = cuts = suspects = 0

    def text(raw: str) -> None:
        if not cuts and raw:
            open_[-1][1].items.append((htmllib.unescape(raw) if "&" in raw else raw, links > 0))

    def push(name: str, node: Node) -> None:
        places[name].append(len(open_))
        if name in BLOCK:
            blocks.append(len(open_))
        open_.append((name, node))

    def close(to: int) -> None:
        nonlocal links, cuts
        while len(open_) > max(to, 1):
            name, node = open_.pop()
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
            links -= name == "a"
            cuts -= node.cut and node is not open_[-1][1]

    def last(names: Iterable[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    at = 0
    for start, end, name, attrs, ends in _Tags(page):
        text(page[at:start])
        at = end
        if not name:
            continue
        block = blocks[-1] if blocks else 0
        if ends:
            place = last((name,))
            if place and (name in BLOCK or place > block):  # a stray inline end tag doesn't close blocks
                close(place)
            continue
        if name == "br":
            text("\n")
            continue
        if name in ("html", "body"):
            if _is_cut(name, attrs)[0]:
                continue
        if name in CLOSES_P and open_[block][0] == "p":
            close(block)
        if name in IMPLIED_END:
            closes, stops = IMPLIED_END[name]
            place = last(closes)
            if place > last(stops):
                close(place)
        if name in VOID:
            if name == "hr":
                open_[-1][1].items.append(Node("hr", open_[-1][1]))
            continue
        if name == "a" and last("a") > (blocks[-1] if blocks else 0):
            close(last("a"))
        cut, suspect = (False, ()) if name in ("html", "body") else _is_cut("div" if name == "header" and places["article"] else name, attrs)
        suspects += len(suspect)
        parent = open_[-1][1]
        if name in BLOCK or cut:
            node = Node(name, parent, cut, suspect)
            parent.items.append(node)
            cuts += cut
            if not attrs.endswith("/") or name in BLOCK:
                push(name, node)
            else:
                cuts -= cut
        else:
            push(name, parent)
        links += open_[-1][0] == "a" and open_[-1][1] is parent
    text(page[at:])
    if suspects:
        _judge(root)
    return root


def _runs(node: Node) -> Iterator[tuple[str, int, int] | Node]:
    """The node's own text between child nodes as (block, its characters, those in links), and the child nodes."""
    parts: list[tuple[str, bool]] = []
    for item in [*node.items, None]:
        if isinstance(item, tuple):
            parts.append(item)
            continue
        block = " ".join("".join(t for t, _ in parts).split())
        if block:
            yield block, len(block), min(len(block), sum(len(" ".join(t.split())) for t, linked in parts if linked))
        parts = []
        if item is not None:
            yield item


def _score(root: Node) -> list[Node]:
    """Passes the points of every kept block up; returns the nodes in page order."""
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        below = []
        for run in _runs(node):
            if isinstance(run, Node):
                if not run.cut:
                    below.append(run)
                continue
            block, chars, linked = run
            points = 1 + min(chars / 100, 3) + block.count(",") + block.count("、") + block.count("，")
            points *= 1 - linked / chars
            # a paragraph's points go to its container; text straight in a container stays there
            up = node.parent if node.name in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "blockquote") and node.parent else node
            up.points += points
            node.chars += chars
            node.linked += linked
        stack.extend(reversed(below))
    for node in reversed(nodes):  # inner ones first, so every node has its points by then
        if node.parent is not None:
            node.parent.points += node.points / 2
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return nodes


def _blocks(node: Node, out: list[str]) -> None:
    stack: list = [_runs(node)]
    while stack:
        run = next(stack[-1], None)
        if run is None:
            stack.pop()
        elif isinstance(run, Node):
            if not run.cut:
                stack.append(_runs(run))
        else:
            out.append(run[0])


def _stays(node: Node, limit: float, shared: bool) -> bool:
    """Whether a sibling of the main container, or of an element around it, is part of the text;
    ``shared``: another sibling scores well, so their parent is the container."""
    if node.cut or not node.chars or node.linked > LINK_LIMIT * node.chars:
        return False
    return node.name in TEXT or (shared and node.name != "article") or node.score() >= limit > 0


def main_text(page: str | None) -> str:
    """The main text of one page."""
    root = parse(page or "")
    nodes = _score(root)
    best = max(nodes, key=lambda n: (n.score(), n.chars))  # the first of equals
    if not best.chars:
        return ""
    around = best
    while around is not None:
        if around.name in ("article", "main"):
            best = around
            break
        around = around.parent
    limit = SIBLING_SHARE * best.score()
    middle: list[str] = []
    _blocks(best, middle)
    before: list[list[str]] = []  # of each element around, the innermost first
    after: list[list[str]] = []
    while best.parent is not None and best.name not in ("main", "body"):
        sides: tuple[list[str], list[str]] = ([], [])
        passed = False
        others = [x for x in best.parent.items if isinstance(x, Node) and x is not best and x.name not in TEXT and x.name != "article"]
        shared = best.parent.name not in ("body", "html") and any(_stays(x, limit, False) for x in others)
        for run in _runs(best.parent):
            if run is best:
                passed = True
            elif isinstance(run, Node):
                if _stays(run, limit, shared):
                    _blocks(run, sides[passed])
            elif run[2] <= LINK_LIMIT * run[1]:
                sides[passed].append(run[0])
        before.append(sides[0])
        after.append(sides[1])
        best = best.parent
    return "\n\n".join([*chain.from_iterable(reversed(before)), *middle, *chain.from_iterable(after)])


def extract(pages: DataFrame, html_col: str = "html", carry: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: the columns named in ``carry``, ``text`` and ``n_chars`` (its code points)."""
    rows, schema = carried(pages, carry, html_col, "text string, n_chars long")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.columns[-1].to_pylist()]
            columns = [pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=schema.names)

    return map_arrow(rows, texts, schema)
