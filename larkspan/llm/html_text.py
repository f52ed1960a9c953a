"""Main text of web pages by composite text density.

A page is read into a tree in one pass over its tags, with implied end tags. Elements
that never hold an article (menus, page headers and footers, side bars, forms, scripts,
styles, notices, adverts, reader comments) are left out, by tag, role or class, unless
the article itself lies inside. For every other node the density is its characters
per tag, adjusted by the share of its characters and tags that are links, against
those of the body. A node's density sum adds up the densities of its children.
The node with the largest sum is the article; the smallest density on the path from
it to the body is the threshold below which nodes inside it that are mostly links
are left out.

Text is collected in page order, a block for each block element: character references
decoded, white space as one space, trimmed, blocks joined by two line feeds.

Defined results: null and empty pages have an empty text; a page without tags is one
block; what follows a tag that does not end is text; repeated rows give a row each. Further
columns are ignored. A page takes time in proportion to its length, however its tags are nested.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Block elements before which an open paragraph ends.
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option".split())
#: Elements that end an open one of their own kind, and the elements that such a search does not leave.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements without article text, whatever is around them.
NEVER = frozenset("head nav footer aside form script style noscript template iframe select button textarea svg canvas object dialog menu title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id attributes that name something else than the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion promotions "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar masthead header footer foot sidebar aside rail widget widgets "
    "comment comments commentlist respond replies reply disqus discussion guestbook "
    "cookie cookies consent gdpr notice notices notification alert warning popup modal overlay subscribe subscription newsletter signup login paywall "
    "share sharing social related recommended recommendations teaser teasers outbrain taboola copyright legal disclaimer skip".split()
)
#: Elements that are parts of an article where they stand beside the densest one.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 section ul ol dl table blockquote pre figure header".split())
#: A class such as has-sidebar tells about the page, not about the element.
ABOUT = frozenset("has with no without layout".split())

#: A comment, a tag, or other markup. Quotes count after "=" only. Nothing is tried twice, so that a page takes linear time.
_TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)(?P<close>>|\Z)"
    r"|[!?/][^>]*+(?:>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "out", "main", "inside")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.out = self.main = False
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


class Open:
    """The open elements: the path from the root, and the depths at which each tag is open."""

    def __init__(self, root: Node):
        self.path = [root]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def enter(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.path))
        if node.tag in BLOCK:
            self.blocks.append(len(self.path))
        self.path.append(node)

    def leave(self, depth: int) -> None:
        """Close the element at ``depth`` and all inside it."""
        while len(self.path) > depth:
            tag = self.path.pop().tag
            self.depths[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open ``tag``; 0 is the root."""
        found = self.depths.get(tag)
        return found[-1] if found else 0

    def outermost(self, tags: set[str], within: set[str]) -> int:
        """The depth of the first of ``tags`` that is open inside the innermost one of ``within``; 0 without one."""
        least = max(map(self.last, within))
        found = (d[k] for d in (self.depths.get(t, []) for t in tags) if (k := bisect_right(d, least)) < len(d))
        return min(found, default=0)


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("html", None)
    nodes, at, n = [root], 0, len(page)
    opened = Open(root)
    while at < n:
        m = _TAG.search(page, at)
        here = opened.path[-1]
        if m is None or m["close"] == "":
            here.children.append(page[at:])
            break
        if m.start() > at:
            here.children.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if depth := opened.last(name):
                opened.leave(depth)
            elif name == "br":
                here.children.append(Node("br", here))
            continue
        if name == "html":
            continue
        if name in SIBLINGS:
            if depth := opened.outermost(*SIBLINGS[name]):
                opened.leave(depth)
        elif name in ENDS_P and opened.blocks and opened.path[opened.blocks[-1]].tag == "p":
            opened.leave(opened.blocks[-1])
        here = opened.path[-1]
        node = Node(name, here, m["attrs"] or "")
        here.children.append(node)
        nodes.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            stop_at = end.start() if end else n
            if name not in ("script", "style"):
                node.children.append(page[at:stop_at])
            at = end.end() if end else n
            continue
        if not (m["attrs"] or "").endswith("/") or name in BLOCK:
            opened.enter(node)
    return root, nodes


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(node.attrs)}


def excluded(node: Node) -> bool:
    """Whether an element holds something else than the article."""
    if node.tag in NEVER:
        return not (node.main and node.tag in ("form", "aside"))
    if node.main or node.tag in ("html", "body", "main"):
        return False
    if node.tag == "header":
        return not node.inside
    return bool(node.attrs) and named_otherwise(node)


def named_otherwise(node: Node) -> bool:
    """Whether role, class or id name something else than the article, or the element is not shown."""
    own = attributes(node)
    if own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true" or _HIDDEN.search(own.get("style", "")):
        return True
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if words and words[0] not in ABOUT and NAMES.intersection(words):
            return True
    return False


def measure(nodes: list[Node]) -> None:
    """Characters, tags and links of each node's subtree, without excluded ones, and its density and density sum."""
    for node in reversed(nodes):
        if node.tag == "main" or (node.tag == "article" and not (node.attrs and named_otherwise(node))) or "main" == ("role" in node.attrs and attributes(node).get("role")):
            node.main = True
        if node.main and node.parent is not None:
            node.parent.main = True
    for node in nodes:
        node.out = (node.parent is not None and node.parent.out) or excluded(node)
    for node in reversed(nodes):
        if node.out:
            continue
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    ratio = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if node.out or not node.chars:
            continue
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + ratio * c + math.e)
        node.density = c / t * max(math.log(c / lc * t / lt + 1), 0.0) / max(math.log(base), 1.0) if base > 1 else c / t
        if node.parent is not None:
            node.parent.total += node.density


def article(nodes: list[Node]) -> tuple[Node, float]:
    """The node with the largest density sum (the first of equals) and the smallest density from it up to the body."""
    best = nodes[0]
    for node in nodes:
        if not node.out and node.tag not in ("html",) and node.total > best.total:
            best = node
    # the text of a main element belongs together, also where one of its parts is the densest
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    # parts beside it that are text as well belong to the same article
    while best.parent is not None and best.parent.tag not in ("html", "body") and all(beside(c, best) for c in best.parent.children):
        best = best.parent
    threshold, up = best.density, best
    while up is not None and up.tag != "html":
        threshold = min(threshold, up.density)
        up = up.parent
    return best, threshold


def beside(child: Node | str, best: Node) -> bool:
    """Whether a sibling of the densest node reads like a part of the same article."""
    if isinstance(child, str) or child is best or child.out or not child.chars:
        return True
    # a short line without links, such as the author's, does not part an article
    return not child.link_chars or (2 * child.link_chars <= child.chars and (child.tag in PARTS or 2 * child.density >= best.density))


def blocks(top: Node, threshold: float) -> list[str]:
    """The text blocks below ``top`` in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = [(top, 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCK:
            flush()
        if k == len(node.children):
            if node.tag in BLOCK:
                flush()
            continue
        stack.append((node, k + 1))
        child = node.children[k]
        if isinstance(child, str):
            run.append(child)
        elif child.tag in ("br", "hr"):
            run.append(" ")
        elif not child.out and not (child.tag in BLOCK and child.density < threshold and 2 * child.link_chars > child.chars):
            stack.append((child, 0))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a whole page."""
    if not page:
        return ""
    _, nodes = parse(page)
    measure(nodes)
    top, threshold = article(nodes)
    return "\n\n".join(blocks(top, threshold))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id_col, url_col, text, n_chars (code points). One scan, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kinds = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    done = rows.mapInPandas(run, f"id {kinds}, url string, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
