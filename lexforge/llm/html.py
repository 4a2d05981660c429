"""Main text of web pages by composite text density.

The page becomes a tree of elements; what never is main text by the meaning of its element, role or style (scripts,
styles, controls, menus, side bars, hidden parts) is cut off; so are forms, field sets and objects, unless they hold an
article or main element or more than half of the text that stays. For every node the link-adjusted number of characters
per tag is computed:

    density = C / T * log_B(C / L * T / K),  B = ln(C / (C - L) * L + L_body / C_body * C + e)

with C characters, T tags, L characters in links and K links (C, T, L, K at least 1 where they divide). A node's sum is the
sum of the densities of its children, but those with a name as below. Of the nodes that hold blocks, the one with the
largest sum is the core; the least density on the path from the core to the body (or to the article or main element with
most of the text) is the threshold. The core stays whole. On the way up from it a sibling is taken too if its density
reaches the threshold; so is a heading before a part that is taken, and a short part between two.

Names (words of class and id) are a second sign only, since a name alone is no proof: a part that is named an advert, a
notice, reader comments and the like can't be the core and is not taken on the way up; inside the core it goes if it
holds blocks of its own or is less dense than the core's parts are in the mean. A named part that holds the page's
article or main element, or, on a page without any, blocks with more than half of its text, doesn't count as named.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.

Defined cases: null or empty html: empty text; no element at all: the whole text; unclosed, wrongly nested or cut
markup: repaired as browsers do in the main; pages of any length and depth are read whole, in time proportional to their
length; equal sums: the node that comes first; repeated rows: alike; no rows: no rows; other columns, whatever their
names, pass through.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexforge.llm.common import free_name

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("script style noscript iframe template head title nav footer aside form button input select option textarea label fieldset object embed svg canvas video audio map menu dialog noembed noframes".split())
#: Those of them that may wrap the main text.
WRAPPERS = frozenset("form fieldset object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of a class or id that name what isn't main text.
NOISE = frozenset(
    (
        "ad ads advert adverts advertisement advertising adbox adslot banner promo promotion sponsor sponsored sponsorship dfp"
        " nav navbar navigation menu breadcrumb breadcrumbs pager pagination topbar toolbar"
        " header masthead footer foot sitefooter siteheader colophon copyright"
        " sidebar side aside rail widget widgets"
        " cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox"
        " comment comments commentlist respond reply replies disqus discussion"
        " share sharing social follow subscribe subscription newsletter signup login signin register search"
        " related recommended recommendations teaser teasers trending popular outbrain taboola"
        " skip hidden"
    ).split()
)

MAIN = frozenset("article content post body entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: What an end tag of another kind doesn't reach out of, and the tags that do.
CELLS, BEYOND_CELLS = frozenset("td th table".split()), frozenset("table tr tbody thead tfoot td th body html article main".split())


class Node:
    __slots__ = ("tag", "parent", "items", "gone", "named", "chars", "links", "tags", "link_tags", "density", "total", "wraps")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, named: bool = False):
        self.tag, self.parent, self.gone, self.named = tag, parent, gone, named
        self.items: list[Node | str] = []


def _signs(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no text by its meaning, and whether its class or id names it so."""
    gone, named = tag in DROPPED and tag not in WRAPPERS, False
    if gone or not attributes or tag in ("html", "body"):
        return gone, named
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and tag not in ("article", "main"):
            for word in value.split():
                parts = [p.lower() for p in PIECES.findall(word)]
                if not parts or parts[0] in ("no", "has", "with", "without") or parts[-1] in MAIN:
                    continue
                found = NOISE.intersection(parts)
                named |= bool(found) and not (found == {"header"} and bool(MAIN.intersection(parts)))
        elif name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            gone = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            gone = True
    return gone, named


class _Open:
    """The open elements, with the depths of each tag, of cells and of blocks other than p, so that no search climbs through them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}
        self.cells: list[int] = []
        self.blocks: list[int] = [0]

    def depth(self, *tags: str) -> int:
        """Depth of the innermost open element with one of the tags; 0: none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def add(self, node: Node) -> None:
        d = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(d)
        if node.tag in CELLS:
            self.cells.append(d)
        if node.tag not in INLINE and node.tag != "p":
            self.blocks.append(d)

    def close(self, depth: int) -> None:
        """Closes all from `depth` on."""
        while len(self.nodes) > max(depth, 1):
            node = self.nodes.pop()
            self.at[node.tag].pop()
            for held in (self.cells, self.blocks):
                if held and held[-1] == len(self.nodes):
                    held.pop()


def parse(page: str) -> Node:
    """The tree of a page. What is no text is marked, not removed."""
    root = Node("#page", None)
    held, at = _Open(root), 0
    find, unclosed = TOKEN.search, set()
    while (m := find(page, at)) is not None:
        if m.start() > at:
            held.nodes[-1].items.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                held.nodes[-1].items.append("\n")
            elif (depth := held.depth(tag)) and (tag in BEYOND_CELLS or not held.cells or depth > held.cells[-1]):
                held.close(depth)
            continue
        if tag in CLOSES_P:
            if (depth := held.depth("p")) > held.blocks[-1]:
                held.close(depth)
            if tag in HEADINGS and held.nodes[-1].tag in HEADINGS:
                held.close(len(held.nodes) - 1)
        elif tag in SAME:
            fence = held.depth(*FENCE[tag])
            depths = [d for t in SAME[tag] if (d := held.depth(t)) > fence]
            if depths:
                held.close(min(depths) if tag == "tr" else max(depths))
        now = held.nodes[-1]
        node = Node(tag, now, *_signs(tag, m[3]))
        now.items.append(node)
        if tag in RAW:  # its content is no markup, and none of it is main text
            end = None if tag in unclosed else re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
            if end is not None:
                at = end.end()
            else:
                unclosed.add(tag)
                if tag in ("script", "style"):
                    at = len(page)
        elif tag not in VOID and not m[3].endswith("/") or tag in ("p", "div", "article") and m[3].endswith("/"):
            held.add(node)
    if at < len(page):
        held.nodes[-1].items.append(page[at:])
    return root


def _children(node: Node) -> list[Node]:
    return [x for x in node.items if type(x) is not str]


def _prune(root: Node) -> None:
    """Cuts off what is no text by its meaning; a header goes too unless it is the heading of an article or main element."""
    _weigh(root)
    most = root.chars / 2
    stack = [(root, False)]
    while stack:
        node, in_article = stack.pop()
        in_article = node.tag in ("article", "main") or in_article and node.tag != "section"
        kept = []
        for x in node.items:
            if type(x) is not str:
                if _dropped(x) or x.tag in WRAPPERS and not x.wraps and x.chars <= most or x.tag == "header" and not (in_article and any(type(y) is not str and y.tag in HEADINGS for y in x.items)):
                    continue
                x.named = x.named and not x.wraps and (x.chars <= most or root.wraps or all(y.tag in INLINE for y in _children(x)))
                stack.append((x, in_article))
            kept.append(x)
        node.items = kept


def _dropped(node: Node) -> bool:
    """Whether an element goes by its meaning: by its role or style only if it doesn't wrap the page's article or main element."""
    return node.gone and (node.tag in DROPPED and node.tag not in WRAPPERS or not node.wraps)


def _weigh(root: Node) -> None:
    """Sets the characters of every node, and whether it wraps an article or main element."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if type(x) is not str]
    for n in reversed(order):
        n.chars, n.wraps = 0, False
        for x in n.items:
            if type(x) is str:
                n.chars += len(x) - sum(map(x.count, " \n\t\r"))
            elif not _dropped(x):
                n.chars += x.chars
                n.wraps |= x.wraps or x.tag in ("article", "main") and not x.gone


def _measure(root: Node) -> list[Node]:
    """Sets counts, density and sum of every node; returns all nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if type(x) is not str]
    order.reverse()
    for n in order:
        n.chars = n.links = n.tags = n.link_tags = 0
        for x in n.items:
            if type(x) is str:
                n.chars += len(x) - x.count(" ") - x.count("\n")
            else:
                n.chars += x.chars
                n.tags += x.tags + 1
                n.links += x.links
                n.link_tags += x.link_tags + (x.tag == "a")
        if n.tag == "a":
            n.links = n.chars
    body = order[-1]
    ratio = body.links / max(body.chars, 1)
    for n in order:
        c, t, links, k = n.chars, max(n.tags, 1), n.links, max(n.link_tags, 1)
        if not c:
            n.density = 0.0
        else:
            base = math.log(c / max(c - links, 1) * links + ratio * c + math.e)
            n.density = c / t * max(0.0, math.log(max(c / max(links, 1) * t / k, 1.0)) / math.log(max(base, 1.0001)))
        n.total = sum(x.density for x in n.items if type(x) is not str and not x.named)
    return order


def select(root: Node) -> list[Node]:
    """The parts that are main text, in page order."""
    order = _measure(root)
    order.reverse()  # parents first, in page order among siblings
    aside = {id(root): False}
    for n in order:
        for x in _children(n):
            aside[id(x)] = aside[id(n)] or x.named
    plain = root.chars - sum(x.chars for n in order if not aside[id(n)] for x in _children(n) if x.named)
    holders = [n for n in order if any(x.tag not in INLINE for x in _children(n))]
    holders = [n for n in holders if not aside[id(n)] and n.chars] or holders
    if not holders:
        return [root]
    # The body, or within it the innermost article or main element with more than half of the text.
    body = next((n for n in order[::-1] if n.tag in ("article", "main") and 2 * n.chars > plain and not aside[id(n)]), root)
    under = {id(body)}
    for n in order:
        if id(n) in under:
            under.update(id(x) for x in _children(n))
    core = max([n for n in holders if id(n) in under] or [body], key=lambda n: (n.total, n.density))
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    parts = [core]
    for inner, parent in zip(path, path[1:], strict=False):
        some = [x for x in _children(parent) if x.chars]
        if inner not in some:
            continue
        at = some.index(inner)
        taken = [i == at or not x.named and x.density >= threshold for i, x in enumerate(some)]
        first, last = taken.index(True), len(taken) - 1 - taken[::-1].index(True)
        taken = [t or first < i < last and not x.named for i, (t, x) in enumerate(zip(taken, some, strict=True))]
        for i in range(len(some) - 2, -1, -1):
            taken[i] = taken[i] or some[i].tag in HEADINGS and taken[i + 1]
        parts = [x for x, t in zip(some[:at], taken[:at], strict=True) if t] + parts + [x for x, t in zip(some[at + 1 :], taken[at + 1 :], strict=True) if t]
    _clear(core)
    return parts


def _clear(core: Node) -> None:
    """Takes named parts out of the core that hold blocks of their own or are less dense than its parts in the mean."""
    dense = [x.density for x in _children(core) if x.chars]
    mean = sum(dense) / max(len(dense), 1)
    stack = [core]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if type(x) is str or not x.named or x.density >= mean and all(y.tag in INLINE for y in _children(x))]
        stack += _children(node)


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under a node, in page order."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif type(x) is str:
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag not in INLINE:
                end()
                stack.append(None)
            stack += reversed(x.items)
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _prune(root)
    return "\n\n".join(x for part in select(root) for x in blocks(part))


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without `html`, with text and n_chars (code points)."""
    rest, given = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")], free_name(pages, "_html")
    names = [f.name for f in rest]
    schema = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(given)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*names, F.col(html).alias(given)).mapInArrow(run, schema)
