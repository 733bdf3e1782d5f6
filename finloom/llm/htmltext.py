"""Main text of web pages by composite text density.

Every node of the page's tree has a density: characters per tag, where characters and tags of links are taken off by
the logarithm of composite text density, so that link lists are thin and prose is dense. A node's density sum adds up
its children's densities. The node of largest density sum is the core; the smallest density on the path from the body
to it is the page's threshold. An article or main element is one more candidate: the outermost one on that path, or one
within the core that holds more than half of the core's text outside links, is the text's box. Without a box, subtrees
beside the path belong to the text if their density reaches the threshold, links hold less than half of them, and they
are no header; children of the core that are mostly links go.

Words of class and id (fixed list below) weigh in the density of what they mark, and of all within it: a name made of
such words alone (with words for parts of a layout) by a tenth, one that begins or ends with such a word by half,
outside articles only. An element marked by its whole name goes unless its weighted density sum puts it on the
path; within the text, elements whose names merely hold such a word stay. Scripts, styles, forms, menus,
footers, asides and what is hidden go by element, role or state. The header of the text loses its lists of links.

Defined results: null and empty pages, and pages without text outside what is cut, give the empty string; broken and
unclosed markup is read as browsers do as far as blocks go, and in linear time: a tag that never ends is text, from the
first tag whose quotes never close on quotes have no meaning, and elements deeper than `DEPTH` are laid side by side;
very long pages are read whole; pages are read one by one, so repeated rows do no harm; an empty table gives an empty
table; further columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CUT = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object embed svg canvas math audio video dialog menu menuitem map noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr caption ul xmp".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An opening tag on the left ends these open elements, up to the nearest of the bounds.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())
#: Words (split at what is no letter, and at capitals) of classes and ids of what is no article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments disqus respond cookie cookies consent gdpr notice newsletter subscribe subscription signup login "
    "popup modal overlay share sharing social related recommended widget pagination pager toolbar skip copyright alert search".split()
)
#: Words for parts of a layout, which say nothing by themselves.
PARTS = frozenset(
    "container wrapper wrap box block section list item items area slot unit bar links link button buttons icons panel inner outer group row column "
    "holder left right top bottom title heading body text thread count meta posts stories".split()
)
#: Classes and ids of the article itself, which outweigh the marks above, and words before the state of an element.
ARTICLE, STATES = frozenset("article post entry story main content".split()), frozenset("has with no not without is".split())
#: Weights of what is marked by whole names, by part of a name, and elements that browsers nest at most.
WHOLE, PARTLY, DEPTH = 0.1, 0.5, 512

_TAG = re.compile(r"</?[a-zA-Z][^\s/>]*+(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_BARE_TAG = re.compile(r"</?[a-zA-Z][^>]*+>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    """An element: children are nodes and decoded strings in page order."""

    __slots__ = ("tag", "children", "cut", "chars", "tags", "link_chars", "link_tags", "density", "weight", "total", "parent", "mark", "depth")

    def __init__(self, tag: str, parent=None, cut: bool = False, mark: float = 1.0):
        self.tag, self.parent, self.cut, self.mark, self.children = tag, parent, cut, mark, []
        self.depth = parent.depth + 1 if parent else 0


def _attributes(token: str, name: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(token[1 + len(name) : -1])}


def _judge(tag: str, token: str) -> tuple[bool, float]:
    """Whether the element goes whatever it holds, and the weight that its class and id give it."""
    if tag in CUT:
        return True, 1.0
    if len(token) < len(tag) + 6 or tag in ("body", "html"):
        return False, 1.0
    given = _attributes(token, tag)
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role") in ROLES or "display:none" in given.get("style", "").replace(" ", ""):
        return tag not in ("article", "main"), 1.0
    mark = 1.0
    for name in (given.get("class", "") + " " + given.get("id", "")).split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if len(words) == 1 and words[0] in ARTICLE:
            return False, 1.0
        if words and words[0] not in STATES and not MARKS.isdisjoint(words):
            if all(w in MARKS or w in PARTS for w in words):
                mark = WHOLE
            elif words[0] in MARKS or words[-1] in MARKS:
                mark = min(mark, PARTLY)
    return False, mark


def _tokens(page: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of tags, comments and declarations, in time linear in the page. The caller may send on from where."""
    pos, last, quotes = 0, page.rfind(">"), True
    while True:
        pos = page.find("<", pos)
        if pos < 0 or pos > last and not page.startswith("<!--", pos):
            return
        end = pos + 1
        if page.startswith("<!--", pos):
            close = page.find("-->", pos + 2)
            end = close + 3 if close >= 0 else len(page)
        elif page[pos + 1 : pos + 2] in ("!", "?"):
            end = page.find(">", pos) + 1
        else:
            found = _TAG.match(page, pos) if quotes else _BARE_TAG.match(page, pos)
            if found is None and quotes and _BARE_TAG.match(page, pos):
                quotes = False
                found = _BARE_TAG.match(page, pos)
            if found is None:  # no tag: text
                pos += 1
                continue
            end = found.end()
        onward = yield pos, end
        pos = onward or end


class _Builder:
    """The tree as it grows; counts of open elements spare walks up the tree, so that every tag costs little."""

    def __init__(self):
        self.root = self.at = Node("#root")
        self.open: dict[str, int] = {}
        self.scopes: list[tuple[Node, dict[str, int]]] = [(self.root, {})]  # open blocks with their open inline elements

    def climb(self, to: Node) -> None:
        """Close what is open below to."""
        while self.at is not to:
            tag = self.at.tag
            self.open[tag] -= 1
            if tag in BLOCK:
                self.scopes.pop()
            else:
                self.scopes[-1][1][tag] -= 1
            self.at = self.at.parent

    def add(self, child: Node | str) -> None:
        self.at.children.append(child)

    def enter(self, node: Node) -> None:
        self.open[node.tag] = self.open.get(node.tag, 0) + 1
        if node.tag in BLOCK:
            self.scopes.append((node, {}))
        else:
            inline = self.scopes[-1][1]
            inline[node.tag] = inline.get(node.tag, 0) + 1
        self.at = node

    def close(self, tag: str) -> None:
        """An end tag: inline elements end within their block, others wherever they are open."""
        if (self.open if tag in BLOCK else self.scopes[-1][1]).get(tag):
            up = self.at
            while up.tag != tag:
                up = up.parent
            self.climb(up.parent)
        elif tag == "p":
            self.add(Node("p", self.at))
        elif tag == "br":
            self.add(" ")

    def make_room(self, tag: str) -> None:
        """End what an opening tag ends."""
        if tag in CLOSES:
            ends, bounds = CLOSES[tag]
            left, up, target = sum(self.open.get(t, 0) for t in ends), self.at, None
            while left and up is not self.root and up.tag not in bounds:
                if up.tag in ends:
                    target, left = up, left - 1
                up = up.parent
            if target is not None:
                self.climb(target.parent)
        elif tag in BLOCK:  # a block ends an open paragraph
            block = self.scopes[-1][0]
            if block.tag == "p":
                self.climb(block.parent)
            if tag in HEADING and self.at.tag in HEADING:
                self.climb(self.at.parent)


def parse(page: str) -> Node:
    """The page's tree below a root; unclosed elements end with what encloses them."""
    tree = _Builder()
    pos, tokens, onward = 0, _tokens(page), None
    while True:
        try:
            begin, end = tokens.send(onward)
        except StopIteration:
            break
        onward = None
        if begin > pos:
            tree.add(html.unescape(page[pos:begin]))
        token, pos = page[begin:end], end
        name = _NAME.match(token)
        if name is None:
            continue  # comments and declarations
        tag = name[1].lower()
        if token[1] == "/":
            tree.close(tag)
            continue
        tree.make_room(tag)
        if tag == "br":
            tree.add(" ")
        if tag in ("br", "wbr"):
            continue
        node = Node(tag, tree.at, *_judge(tag, token))
        tree.add(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I).search(page, pos)
            node.children.append(page[pos : close.start() if close else len(page)])
            pos = onward = close.end() if close else len(page)
        elif tag not in VOID and not token.endswith("/>") and node.depth < DEPTH:
            tree.enter(node)
    if pos < len(page):
        tree.add(html.unescape(page[pos:]))
    return tree.root


def _prune(root: Node) -> None:
    """Take out what goes whatever it holds."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not c.cut]
        todo.extend(c for c in node.children if isinstance(c, Node))


def _nodes(root: Node) -> list[Node]:
    """Elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node))
    return out


def measure(root: Node) -> list[Node]:
    """Set chars, tags, link_chars, link_tags, density, weight and total (the density sum) of all nodes; parents first."""
    order = _nodes(root)
    for node in reversed(order):
        node.chars = sum(len(_SPACE.sub("", c)) for c in node.children if isinstance(c, str))
        node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, Node):
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
    linked, chars = root.link_chars, max(root.chars, 1)
    inside = set()  # articles and all within them
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, linked, chars)
        if node.tag in ("article", "main") or node.parent in inside:
            inside.add(node)
        own = WHOLE if node.tag == "header" and node not in inside else node.mark if node.mark != PARTLY or node not in inside else 1.0
        node.weight = own * (node.parent.weight if node.parent else 1.0)
    for node in order:
        node.total = sum(c.density * c.weight for c in node.children if isinstance(c, Node))
    return order


def density(c: int, t: int, lc: int, lt: int, body_links: int, body_chars: int) -> float:
    """Composite text density of c characters under t tags, lc of them in lt links."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_links / body_chars * c + math.e)
    inner = c / max(lc, 1) * max(t, 1) / max(lt, 1)
    return c / max(t, 1) * max(math.log(inner) / math.log(max(base, 1.0001)), 0.0) if inner > 1 and base > 1 else c / max(t, 1) * (inner > 1)


def _path(node: Node) -> list[Node]:
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _text(nodes: list) -> str:
    """Blocks of the nodes in page order: white space to one blank, trimmed, joined by line feeds."""
    blocks, run = [], []

    def flush() -> None:
        line = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if line:
            blocks.append(line)

    todo = [(n, False) for n in reversed(nodes)]
    while todo:
        node, done = todo.pop()
        if isinstance(node, str):
            run.append(node)
        elif done:
            flush()
        elif not node.cut:
            if node.tag in BLOCK:
                flush()
                todo.append((node, True))
            todo.extend((c, False) for c in reversed(node.children))
    flush()
    return "\n".join(blocks)


def _plain(node: Node) -> int:
    """Characters outside links."""
    return node.chars - node.link_chars


def _box(core: Node, path: list[Node]) -> Node | None:
    """The article or main element that the core lies in, or that holds most of the core's text outside links."""
    for tag in ("article", "main"):
        for node in reversed(path):
            if node.tag == tag and node.mark == 1.0:
                return node
    todo, found = [core], []
    while todo:
        node = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                (found if c.tag in ("article", "main") and c.weight == core.weight else todo).append(c)
    best = max(found, key=_plain, default=None)
    return best if best is not None and 2 * _plain(best) > _plain(core) else None


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars >= node.chars > 0


def _thin_out(top: Node, on_path: set[Node]) -> None:
    """Cut what is marked by its whole name beside the path (its weighted density sum would have made it the core), and
    the lists of links of a header."""
    todo = [(top, False)]
    while todo:
        node, header = todo.pop()
        for c in node.children:
            if isinstance(c, Node):
                if c not in on_path and (c.mark == WHOLE or (header and c.tag in BLOCK and c.link_tags > 1 and _mostly_links(c))):
                    c.cut = True
                else:
                    todo.append((c, header or c.tag == "header"))


def extract(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    order = measure(root)
    if not root.chars:
        return ""
    core = max(order, key=lambda n: n.total)
    if not core.total:  # no element holds text
        return _text([root])
    path = _path(core)
    body = next((n for n in order if n.tag == "body"), root)
    upto = path.index(body) + 1 if body in path else len(path)
    threshold = min(n.density for n in path[:upto])
    on_path = set(path)
    box = _box(core, path)
    if box is not None:
        _thin_out(box, on_path)
        return _text([box])
    _thin_out(core, on_path)
    for c in core.children:
        if isinstance(c, Node) and c.tag in BLOCK and _mostly_links(c) and (c.tag != "p" or c.link_tags > 1):
            c.cut = True
        elif isinstance(c, Node) and c.tag == "header" and core is body:
            c.cut = True
    chosen: list = []
    todo: list = [path[-1]]
    while todo:  # in page order
        c = todo.pop()
        if isinstance(c, str) or c is core:
            chosen.append(c)
        elif c in on_path:
            todo.extend(reversed(c.children))
        elif c.tag in HEADING or (c.tag != "header" and c.density * c.mark >= threshold and not _mostly_links(c)):
            _thin_out(c, on_path)
            chosen.append(c)
    return _text(chosen)


@F.pandas_udf(T.StringType())
def _extract(pages: pd.Series) -> pd.Series:
    return pd.Series([extract(p) for p in pages], dtype=object)


def extract_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (code points)."""
    out = pages.drop(*[c for c in pages.columns if c in ("text", "n_chars")])
    return out.withColumn("text", _extract(F.col(column))).withColumn("n_chars", F.char_length("text").cast("long"))
