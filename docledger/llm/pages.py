"""Main text of web pages by wrapper induction over pages of one host.

Pages of a host are dealt to groups of bounded size. Within a group every page's tree
is aligned with a reference page by simple tree matching: the best order-preserving
pairing of children with equal heads, from the roots down. A node whose text is the
same on nearly all differing pages belongs to the template; nodes whose text varies
are slots. The wrapper's main slot is the article or main element, else the smallest
region with all varying text outside links and outside parts that by their markup hold
no article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages that are induced together.
GROUP_PAGES = 200
#: Characters of html whose trees a group keeps; those of more are read again each time.
GROUP_CHARS = 8_000_000
#: Hosts that are split into several groups; by their weight there cannot be more.
MOST_SPLIT = 1_000_000
#: Share of differing pages, and their least number, that make a text a template's.
CONSTANT, LEAST_PAGES = 0.9, 5

_TAG = re.compile(
    r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
                   "param", "source", "track", "wbr"))
_INLINE = frozenset((
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub",
    "sup", "td", "th", "time", "tt", "u", "var", "br", "wbr", "img"))
#: Parts that hold no article by their element.
_OTHER = frozenset((
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu",
    "svg", "object", "canvas", "audio", "video")) | _RAW
#: Small parts that hold no article by a word of their class, id or role.
_OTHER_NAMES = frozenset((
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay",
    "sidebar", "side", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "header", "masthead", "footer", "copyright", "comment", "comments",
    "discussion", "replies", "disqus", "related", "share", "sharing", "social", "newsletter",
    "subscribe", "signup", "login", "search", "searchbox", "widget", "toolbar", "pagination"))
_MAIN = ("article", "main")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose names say nothing about what they hold.
_WRAPPERS = frozenset(("html", "body", *_MAIN, *_HEADINGS)) | _INLINE - {"td", "th"}
#: Words of an id beside which _OTHER_NAMES still speak of a part of the page. An id with
#: any other word is taken for one made from a heading.
_LAYOUT_WORDS = frozenset((
    "", "section", "box", "block", "wrapper", "container", "area", "bar", "slot", "list", "form",
    "post", "site", "main", "page", "top", "bottom", "left", "right", "inner", "outer", "content"))
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)}
_HOLDERS = frozenset(("html", "body", "article", "main", "section", "div", "nav", "aside",
                      "header", "footer", "form", "table", "ul", "ol", "dl"))


class Node:
    """An element: tag, other (holds no article), children (nodes and texts).

    `named`: a word of its names speaks against an article; see _essential.
    """

    __slots__ = ("tag", "names", "other", "named", "children", "shape", "at")

    def __init__(self, tag: str, names: frozenset, other: bool, named: bool = False) -> None:
        self.tag, self.names, self.other, self.named = tag, names, other, named
        self.children: list = []
        self.shape = 0
        self.at = -1

    def nodes(self) -> list[Node]:
        return [c for c in self.children if c.__class__ is Node]

    def own_text(self, links: bool = True) -> str:
        """The text of this block, less that of blocks inside it."""
        parts, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if c.__class__ is str:
                parts.append(c)
            elif c.tag in _INLINE and not c.other and (links or c.tag != "a"):
                todo += reversed(c.children)
        return " ".join("".join(parts).split())


def parsed(source: str) -> Node:
    """A tree of any string; open ends are closed, ends without start are ignored."""
    root = Node("#", frozenset(), False)
    stack, at = [root], 0
    find = _TAG.search
    while True:
        tag = find(source, at)
        text = source[at: tag.start()] if tag else source[at:]
        if text and not text.isspace():
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        elif text:
            stack[-1].children.append(" ")
        if not tag:
            return _shaped(root)
        at = tag.end()
        name = tag.group(2)
        if not name:
            continue
        name = name.lower()
        if tag.group(1):
            _close(stack, name)
            continue
        rest = tag.group(3)
        names, named = _words(name, rest)
        if name not in _INLINE:
            _close_open_paragraph(stack)
        for closed in _CLOSES.get(name, ()):
            _close(stack, closed, _HOLDERS)
        node = Node(name, names, name in _OTHER, named)
        stack[-1].children.append(node)
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in _VOID and not rest.endswith("/"):
            stack.append(node)


def _words(tag: str, attributes: str) -> tuple[frozenset, bool]:
    """(words of class, id and role, whether they speak against an article)."""
    if not attributes or attributes.isspace():
        return frozenset(), False
    names, telling = set(), set()
    for kind, *value in _NAMES.findall(attributes):
        found = set(re.split(r"[^a-z0-9]+", "".join(value).lower()))
        names |= found
        if kind.lower() != "id" or all(
                w in _OTHER_NAMES or w in _LAYOUT_WORDS or w.isdigit() for w in found):
            telling |= found
    return frozenset(names), tag not in _WRAPPERS and not telling.isdisjoint(_OTHER_NAMES)


def _close(stack: list[Node], name: str, stop: frozenset = frozenset()) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == name:
            del stack[i:]
            return
        if stack[i].tag in stop or (name in _INLINE and stack[i].tag not in _INLINE):
            return


def _close_open_paragraph(stack: list[Node]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "p":
            del stack[i:]
            return
        if stack[i].tag in _HOLDERS:
            return


def _shaped(root: Node) -> Node:
    """Gives each node the hash of its subtree's heads, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.nodes()
    for node in reversed(order):
        node.shape = hash((node.tag, node.names, tuple(c.shape for c in node.nodes())))
    return root


def _score(a: Node, b: Node, seen: dict) -> int:
    """Simple tree matching: the most pairs of nodes two trees can share in order.

    `seen` must have the pairs of children with equal heads, see _matched.
    """
    if a.tag != b.tag or a.names != b.names:
        return 0
    return seen[a.shape, b.shape]


def _matched(xs: list[Node], ys: list[Node], seen: dict) -> None:
    """Puts the scores of all pairs of xs and ys with equal heads into `seen`, children first."""
    todo = _unmatched(xs, ys, seen)
    while todo:
        a, b = todo[-1]
        if (a.shape, b.shape) not in seen:
            below = _unmatched(a.nodes(), b.nodes(), seen)
            if below:
                todo += below
                continue
            seen[a.shape, b.shape] = 1 + _table(a.nodes(), b.nodes(), seen)[-1][-1]
        todo.pop()


def _unmatched(xs: list[Node], ys: list[Node], seen: dict) -> list[tuple[Node, Node]]:
    return list({(x.shape, y.shape): (x, y) for x in xs for y in ys if x.tag == y.tag
                 and x.names == y.names and (x.shape, y.shape) not in seen}.values())


def _table(xs: list[Node], ys: list[Node], seen: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row, best = rows[-1], [0], 0
        for j, y in enumerate(ys):
            best = max(best, above[j + 1], above[j] + _score(x, y, seen))
            row.append(best)
        rows.append(row)
    return rows


def aligned(page: Node, reference: Node, seen: dict) -> None:
    """Sets `at` of each page node to that of its partner in the reference."""
    todo = [(page, reference)]
    while todo:
        a, b = todo.pop()
        a.at = b.at
        xs, ys = a.nodes(), b.nodes()
        if a.shape == b.shape:
            todo += zip(xs, ys)
            continue
        _matched(xs, ys, seen)
        rows = _table(xs, ys, seen)
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i][j - 1]:
                j -= 1
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((xs[i], ys[j]))


def _walk(node: Node) -> Iterator[Node]:
    """All blocks that may hold an article, parents first."""
    todo = [node]
    while todo:
        node = todo.pop()
        if node.tag not in _INLINE:
            yield node
        todo += [c for c in reversed(node.nodes()) if not c.other]


class Pages:
    """The trees of a group's pages, aligned with the first, the reference.

    Its nodes are numbered in document order. Only the reference stays in memory if
    the group is long.
    """

    def __init__(self, sources: list[str]) -> None:
        self.sources, self.seen, self.marks = sources, {}, None
        self.reference = parsed(sources[0])
        todo, n = [self.reference], 0
        while todo:
            node = todo.pop()
            node.at, n = n, n + 1
            todo += reversed(node.nodes())
        self.short = sum(map(len, sources)) <= GROUP_CHARS
        self.trees: dict[int, Node] = {0: self.reference}

    def __getitem__(self, i: int) -> Node:
        if i >= len(self.sources):
            raise IndexError(i)
        page = self.trees.get(i)
        if page is None:
            page = parsed(self.sources[i])
            aligned(page, self.reference, self.seen)
            if self.marks:
                _mark(page, *self.marks)
            if self.short:
                self.trees[i] = page
        return page

    def mark(self, template: dict[int, str], essential: set[int]) -> None:
        """Makes named parts other, in all pages that are read from now on too."""
        for page in self.trees.values():
            _mark(page, template, essential)
        self.marks = template, essential


def induced(pages: Pages) -> tuple[dict[int, str], frozenset]:
    """(texts of template nodes, the main regions) by places of the reference.

    Parts that hold no article by their names are marked on the way.
    """
    reference = pages.reference
    different, template = _template(pages)
    weights = _weights(pages, different, template)
    essential = {n.at for n in _essential(_varying(reference, {}), lambda n, _: weights[n.at])}
    pages.mark(template, essential)
    different, template = _template(pages)
    return template, _region(reference, _weights(pages, different, template))


def _template(pages: Pages) -> tuple[list[int], dict[int, str]]:
    """(numbers of pages that differ in their texts, texts that nearly all of them have)."""
    different: dict[int, int] = {}
    texts: dict[int, Counter] = {}
    for i, page in enumerate(pages):
        blocks = [(node.at, node.own_text()) for node in _walk(page)]
        key = hash(tuple(text for _, text in blocks))
        if key in different:
            continue
        different[key] = i
        for at, text in blocks:
            if at >= 0 and text:
                texts.setdefault(at, Counter())[text] += 1
    template = {}
    if len(different) >= LEAST_PAGES:
        for at, counts in texts.items():
            text, count = counts.most_common(1)[0]
            if count >= CONSTANT * len(different):
                template[at] = text
    return list(different.values()), template


def _weights(pages: Pages, different: list[int], template: dict[int, str]) -> Counter:
    """Varying characters by places of the reference; with those in links if there are no others."""
    for links in (False, True):
        weights = Counter()
        for i in different:
            for node, _, weight in _varying(pages[i], template, links):
                if node.at >= 0:
                    weights[node.at] += weight
        if weights[0]:
            break
    return weights


def _varying(page: Node, template: dict[int, str], links: bool = False) -> list[list]:
    """[node, place of its parent, characters outside links and template in it], parents first."""
    rows: list[list] = []
    todo = [(page, -1, True)]
    while todo:
        node, parent, counts = todo.pop()
        if node.tag == "a":
            counts = counts and links
        elif node.tag not in _INLINE:
            counts = node.at not in template or template[node.at] != node.own_text()
        own = sum(len(" ".join(c.split())) for c in node.children
                  if c.__class__ is str) if counts else 0
        todo += [(c, len(rows), counts) for c in reversed(node.nodes()) if not c.other]
        rows.append([node, parent, own])
    for _, parent, weight in reversed(rows):
        if parent >= 0:
            rows[parent][2] += weight
    return rows


def _essential(rows: list[list], weight: Callable[[Node, int], int]) -> list[Node]:
    """The nodes that no name makes other: what holds most of the text, or the article."""
    weights = [weight(node, own) for node, _, own in rows]
    kept = [node for (node, *_), w in zip(rows, weights) if 2 * w > weights[0]]
    at = _article(rows, weights)
    while at >= 0:
        kept.append(rows[at][0])
        at = rows[at][1]
    return kept


def _article(rows: list[list], weights: list[int]) -> int:
    """The row of the weightiest article inside the fewest named parts, -1 without one."""
    around: list[int] = []
    for node, parent, _ in rows:
        around.append((around[parent] if parent >= 0 else 0) + node.named)
    return max((i for i, (node, *_) in enumerate(rows) if node.tag in _MAIN),
               key=lambda i: (-around[i], weights[i]), default=-1)


def _mark(page: Node, template: dict[int, str], essential: set[int]) -> None:
    """Makes named parts other, by the group's evidence or, without partner, by the page's."""
    rows = _varying(page, template)
    if any(node.named and node.at < 0 for node, *_ in rows):
        own = rows if rows[0][2] else _varying(page, template, links=True)
        alone = {id(node) for node in _essential(own, lambda _, weight: weight)}
    for node, *_ in rows:
        if node.named:
            node.other = node.at not in essential if node.at >= 0 else id(node) not in alone


def _region(reference: Node, weights: Counter) -> frozenset:
    """The places of the article and of articles beside it, else of the smallest part with
    all of the weight."""
    rows = _varying(reference, {})
    at = _article(rows, [weights[node.at] for node, *_ in rows])
    if at >= 0:
        return frozenset({rows[at][0].at} | {
            node.at for node, parent, _ in rows if parent == rows[at][1] and weights[node.at]
            and node.tag == rows[at][0].tag == "article" and not node.named})
    node = reference
    while weights[node.at]:
        inner = [c for c in node.nodes() if not c.other and c.tag in _HOLDERS]
        best = next((c for c in inner if weights[c.at] == weights[node.at]), None)
        if best is None:
            break
        node = best
    return frozenset((node.at,))


def _starts(page: Node, region: frozenset) -> list[Node]:
    """The page's nodes in the region, and articles of its own beside them, in order."""
    nodes = list(_walk(page))
    found = [n for n in nodes if n.at in region]
    if not found:
        found = [n for n in nodes if n.tag in _MAIN][:1]
    if not found:
        return [page]
    if any(n.tag == "article" for n in found):
        own = {id(n) for n in found}
        for node in nodes:
            children = [c for c in node.nodes() if not c.other]
            if any(id(c) in own for c in children):
                own |= {id(c) for c in children if c.tag == "article" and c.at < 0}
        found = [n for n in nodes if id(n) in own]
    return found


def extracted(page: Node, template: dict[int, str], region: frozenset) -> str:
    """Blocks of the main regions, in order, joined by an empty line.

    Of a header inside an article or main element its headings are taken, not its lines
    on authors, dates and the like.
    """
    starts = _starts(page, region)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = [x for n in reversed(starts) for x in (None, n)]
    headings = any(n.tag in _MAIN for n in starts)
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif node.__class__ is str:
            line.append(node)
        elif node.other:
            if headings and node.tag == "header" and not node.named:
                todo += [x for n in reversed(_inside(node, _HEADINGS)) for x in (None, n, None)]
        else:
            if node.tag not in _INLINE:
                flush()
                todo.append(None)
            elif node.tag in ("br", "td", "th"):
                line.append(" ")
            if node.tag not in _INLINE and template.get(node.at, "") == node.own_text():
                todo += _blocks_inside(node)
            else:
                todo += reversed(node.children)
    flush()
    return "\n\n".join(blocks)


def _inside(node: Node, tags: tuple) -> list[Node]:
    """The outermost nodes of these tags below a node, in order."""
    found, todo = [], list(reversed(node.nodes()))
    while todo:
        c = todo.pop()
        if c.tag in tags:
            found.append(c)
        elif not c.other:
            todo += reversed(c.nodes())
    return found


def _blocks_inside(node: Node) -> list[Node]:
    """The nearest blocks below a node, last first."""
    found, todo = [], node.nodes()
    while todo:
        c = todo.pop()
        if c.tag in _INLINE and not c.other:
            todo += c.nodes()
        else:
            found.append(c)
    return found


def _group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("order", "ascending"), ("page_id", "ascending")])
    pages = Pages([x or "" for x in table.column("html").to_pylist()])
    template, region = induced(pages)
    return pa.table({
        "page_id": table.column("page_id"), "url": table.column("url"),
        "text": pa.array([extracted(p, template, region) for p in pages], pa.string())})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): one row per input row.

    A null html is empty and gives an empty text. The host is what follows the
    scheme in the url, lower-cased; pages without one form one host. Hosts of many
    pages are split by a hash of the page, so groups are bounded whatever the largest
    host is. How long pages are does not change their groups. Rows that repeat a page each give a row; pages with
    equal texts count once when a template is told from content. A page that does not
    fit the reference is read by its own markup. A part whose class, id or role speaks
    of adverts, comments and the like is left out unless it is an html, body, main,
    article, heading or inline element, holds the article, or holds more than half of the
    varying text; an id counts only if it has no words but such and those of layout.
    Articles side by side are one text. Of a header inside an article the headings stay.
    In a group of fewer than LEAST_PAGES different pages nothing is a template, as equal
    texts of so few pages prove nothing. Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][\w+.-]*://([^/?#]*)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    weight = F.count(F.lit(1)) / GROUP_PAGES
    hosts = rows.groupBy("host").agg(weight.alias("weight"))
    total = hosts.agg(F.sum("weight")).first()[0] or 0.0
    large = hosts.where(F.col("weight") > max(1.0, total / MOST_SPLIT)).select(
        F.col("host").alias("large"), F.ceil("weight").alias("parts"))  # MOST_SPLIT rows at most
    order = F.xxhash64("page_id", "url")
    dealt = rows.join(F.broadcast(large), F.col("host") == F.col("large"), "left").select(
        "page_id", "url", "html", "host", order.alias("order"),
        F.pmod(order, F.coalesce("parts", F.lit(1))).alias("part"))
    texts = dealt.groupBy("host", "part").applyInArrow(
        _group, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
