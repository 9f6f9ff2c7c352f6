"""Main text of HTML pages by composite text density.

A page becomes a tree of block elements and links; markup inside a line (b, span, br)
is part of its block. For every node: characters per tag, adjusted by the share of
link characters and link tags; a node's density sum is that of its child blocks. The
node of the largest sum is the article; the least density on its path to the body is
the threshold that siblings along the path must reach to be part of it. An <article>
around that node is taken whole; in a <main> around it, blocks that hold text themselves
(paragraphs, lists, tables) need not reach the threshold, other containers must.
Elements that by their name, class, id or role are navigation, forms, adverts, notices
or reader comments are marked: they count towards the densities around them but are
left out of sums and text. A mark must leave a text to choose from: an element that,
outside of links and of other marks, holds a sentence and a multiple of all that is
outside of marks (LIFT for each mark on its path: ten times for what may frame a page,
such as a form, header or sidebar) loses its mark, until none does, and densities
choose within.
Defined cases: a null or empty page, or one without text, gives an empty text; markup
that is cut off or badly nested is closed where the next block starts; repeated rows
are extracted alike; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text ends a block before and after them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is text up to their own end tag, and never main text.
RAW = frozenset("script style textarea title noscript iframe template svg math noembed noframes object select".split())
#: Elements marked by their name, and those of them that may frame a whole page.
DROPPED = frozenset("head nav header footer aside form button menu dialog label input option fieldset search".split()) | RAW
FRAMES = frozenset("header aside form fieldset".split())
#: Words of class, id or role that mark an element, and those of them that may name a frame. A name counts if all its parts are such words or COMPANIONS ("site-footer", "ad-slot"; not "social-policy").
DROPPED_WORDS = frozenset(
    "ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies disqus footer header hidden masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
FRAME_WORDS = frozenset("ad ads advert alert banner header masthead modal notice popup promo promotion sidebar signup social sponsored subscribe toolbar widget".split())
#: Words of place and form beside a marking word.
COMPANIONS = frozenset("area articles bar block bottom box btn button buttons center col column consent container content count form global group icons inner item items left links list main message outer page panel posts primary reader right secondary section site slot sticky tags text thread top unit user wrap wrapper".split())
#: Blocks that hold text themselves.
TEXTS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters outside links that make a sentence.
SENTENCE = 60
#: How many times the unmarked text an element of each mark must hold to lose it.
LIFT = {1: 10, 2: 50}
#: A start tag closes open elements of these names, up to the nearest container.
CLOSES = {
    "li": ("li", frozenset(["ul", "ol", "menu"])), "dd": ("dd dt", frozenset(["dl"])), "dt": ("dd dt", frozenset(["dl"])), "option": ("option", frozenset(["select"])),
    "tr": ("tr td th", frozenset(["table"])), "td": ("td th", frozenset(["tr", "table"])), "th": ("td th", frozenset(["tr", "table"])),
}
#: A comment, a tag (quotes count after "=" only; one that the page's end cuts off ends there) or a declaration.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?+)*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


class Node:
    """mark: 0 none, 1 a frame's, 2 any other's."""

    __slots__ = ("name", "parent", "items", "mark", "dropped", "own", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, mark: int = 0):
        self.name, self.parent, self.mark, self.dropped = name, parent, mark, False
        self.items: list[str | Node] = []
        self.own = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def mark_of(name: str, attributes: str) -> int:
    mark = 0 if name not in DROPPED else 1 if name in FRAMES else 2
    for m in MARKS.finditer(attributes):
        kind, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and re.search(r"display\s*:\s*none", value)):
            return 2
        if kind in ("class", "id", "role"):
            for token in value.split():
                parts = set(re.findall(r"[a-z]+|[^\x00-\x7f]+", token))
                if parts <= DROPPED_WORDS | COMPANIONS:
                    for word in parts & DROPPED_WORDS:
                        mark = max(mark, 1 if word in FRAME_WORDS else 2)
    return mark


def walk(root: Node) -> list[Node]:
    """All nodes, children before parents."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in node.items if isinstance(x, Node)]
    return order[::-1]


def settle_marks(root: Node) -> None:
    """Lift marks until a text is left to choose from, and pass those that stay down the tree."""
    order = walk(root)

    def marked() -> list[tuple[int, Node]]:
        """The marked nodes, each with the product of LIFT over the marks on its path; fills in each node's text outside of links and of marked nodes below it."""
        for node in order:
            node.own = 0 if node.name == "a" else sum(len(x.strip()) if isinstance(x, str) else 0 if x.mark else x.own for x in node.items)
        lift, found = {id(None): 1}, []
        for node in reversed(order):
            lift[id(node)] = LIFT.get(node.mark, 1) * lift[id(node.parent)]
            if node.mark:
                found.append((lift[id(node)], node))
        return found

    while found := marked():
        lift, best = max(found, key=lambda x: x[1].own / x[0])
        if best.own < SENTENCE or root.own * lift > best.own:
            break
        while best is not None:
            best.mark, best = 0, best.parent
    for node in reversed(order):
        node.dropped = bool(node.mark) or (node.parent is not None and node.parent.dropped)


class Open:
    """The open elements, with the depths at which each name is open, so that no tag walks up the tree to find its partner."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.solid = [root], defaultdict(list), [0]

    def push(self, node: Node) -> None:
        self.depths[node.name].append(len(self.nodes))
        if node.name in BLOCKS and node.name != "p":
            self.solid.append(len(self.nodes))
        self.nodes.append(node)

    def deepest(self, names: Iterable[str]) -> int:
        """Depth of the innermost open element of these names; 0 if none is."""
        return max((self.depths[x][-1] for x in names if self.depths[x]), default=0)

    def close(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.depths[node.name].pop()
            if self.solid[-1] == len(self.nodes):
                self.solid.pop()


def parse(page: str) -> Node:
    root = Node("body", None)
    at, n, opened = 0, len(page), Open(root)

    def text(upto: int) -> None:
        if upto > at:
            opened.nodes[-1].items.append(page[at:upto])

    for_search = TAG.search
    while at < n:
        m = for_search(page, at)
        if not m:
            text(n)
            break
        text(m.start())
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if m[1]:
            depth = opened.deepest([name])
            # an end tag of an inline element does not reach beyond its block
            inline = name not in BLOCKS and name not in DROPPED
            if depth > (max(opened.solid[-1], opened.deepest("p")) if inline else 0):
                opened.close(depth)
            continue
        if name == "br" or name == "hr":
            opened.nodes[-1].items.append(" " if name == "br" else Node("hr", opened.nodes[-1]))
            continue
        if name in VOID:
            continue
        if name in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES or name in BLOCKS:
            closed, container = CLOSES.get(name, ("p", frozenset()))
            depth = opened.deepest(closed.split())
            if depth > (opened.deepest(container) if name in CLOSES else opened.solid[-1]):
                opened.close(depth)
        child = Node(name, opened.nodes[-1], mark_of(name, m[3]))
        child.parent.items.append(child)
        if not m[3].endswith("/") or name in BLOCKS:
            opened.push(child)
    return root


def measure(root: Node) -> list[Node]:
    """Fill in counts and densities; the nodes, children before parents."""
    order = walk(root)
    for node in order:
        for x in node.items:
            if isinstance(x, Node):
                node.chars += x.chars
                node.tags += x.tags + (x.name in BLOCKS or x.name == "a")
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.name == "a")
            else:
                node.chars += len(x.strip())
        if node.name == "a":
            node.link_chars = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        node.density = c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0 + 1e-9), max(base, 1.0 + 1e-9)) if c else 0.0
        for x in node.items:
            if isinstance(x, Node) and not x.dropped:
                node.total += x.density if x.name in BLOCKS else x.total
    return order


def blocks(node: Node, keep=lambda child: True) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    out, line = [], []
    stack: list = [iter([node])]

    def end() -> None:
        said = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if said:
            out.append(said)

    opened: list[Node] = []
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
            if opened and opened.pop().name in BLOCKS:
                end()
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped and keep(x):
            if x.name in BLOCKS:
                end()
            opened.append(x)
            stack.append(iter(x.items))
    end()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    settle_marks(root)
    order = measure(root)
    best = max((x for x in reversed(order) if not x.dropped), key=lambda x: x.total)
    if not best.total:
        return "\n".join(blocks(root))
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    article = next((i for i, x in enumerate(path) if x.name == "article"), 0)
    threshold = min(x.density for x in path)
    above = set(map(id, path[article + 1 :]))
    on_path = set(map(id, path))

    def keep(child: Node) -> bool:
        if child.parent is None or id(child.parent) not in above or id(child) in on_path:
            return True
        return child.density >= threshold or child.name in (TEXTS if child.parent.name == "main" else HEADINGS)

    return "\n".join(blocks(root, keep))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["page_id", "url"]].assign(text=[main_text(p) for p in f["html"]])

    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kind('page_id')}, url {kind('url')}, text string")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
