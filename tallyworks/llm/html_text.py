"""Main text of web pages by composite text density.

A page becomes a tree of its block elements; inline elements only give text and links. Menus, page headers,
footers, sidebars, notices, adverts, forms, scripts and comments that say so by tag, role, class or id
are left out. Every node has a density: its characters per tag, scaled down by the share of characters
and tags that are links. The node whose children's densities have the highest sum holds the main text. The
least dense node on the way from the body to it sets the threshold: every node that is as dense adds the node with
the highest sum below it. Where the text stands in an article, that holds within articles as dense as the
threshold, and their headings are added; inside an article a class or id has to say more to have an element left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.llm.shared import prepare

# No part gives back what it took, and a tag is only looked for where a ">" is ahead, so that broken markup is read
# in one go.
_TOKEN = re.compile(
    r"<!--(?:(?!--!?>).)*+(?:--!?>|\Z)|<[!?][^>]*+>"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
}
#: Elements that are never part of the main text.
DROPPED = {
    "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "canvas", "object", "head", "datalist",
    "audio", "video", "math", "fieldset", "applet", "map",
}
ROLES = {
    "navigation", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar",
    "status", "tablist",
}
#: Parts of a class or id that say what an element is for.
LABELS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "legal", "login", "menu",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination",
    "popup", "privacy", "promo", "promotion", "promoted", "recommended", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "sponsors", "subscribe", "subscription", "toc", "toolbar", "widget",
}
#: What an article may be about: inside one, an id of such a word only names a place in the text.
TOPICS = {
    "advertising", "alert", "consent", "cookie", "cookies", "copyright", "disclaimer", "legal", "login", "menu", "navigation", "newsletter",
    "notice", "notices", "notification", "overlay", "privacy", "promotion", "replies", "search", "sharing", "social", "sponsors", "subscription",
}
#: Words that only say what an element looks like or where it is, and leave a label what it is.
SHAPES = {
    "area", "banner", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "footer", "form",
    "group", "header", "icon", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "outer", "panel", "post", "posts",
    "right", "row", "section", "slot", "text", "title", "top", "unit", "wrap", "wrapper",
}
HEADS = {"header", "banner", "masthead"}  # dropped unless they stand inside the article
ARTICLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a paragraph ends with; an open one of these keeps a paragraph outside it open.
P_ENDS = {"td", "th", "li", "div", "article", "section", "blockquote", "body"}
#: A start tag closes an open element of these names, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}


@dataclass
class Node:
    tag: str
    parent: int
    dropped: bool = False
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    own: int = 0  # characters of the node's own text


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # (node, text) in page order


def _drops(tag: str, rest: str, in_article: bool) -> bool:
    """Whether an element is left out with all it holds."""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if len(rest) < 6 or tag in ("html", "body"):
        return False
    values = {}
    for m in _ATTRIBUTE.finditer(rest[:-1]):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    if "display:none" in values.get("style", "").replace(" ", "").lower():
        return True
    role = values.get("role", "").lower()
    if role in ROLES or role == "banner" and not in_article:
        return True
    if tag in ARTICLES and "comment" not in values.get("class", ""):
        return False
    names = [*values.get("class", "").split(), values.get("id", "")]
    parts = [{p.lower() for p in _NAME_PART.findall(name)} for name in names]
    if not in_article:
        return any(not p.isdisjoint(LABELS) or not p.isdisjoint(HEADS) for p in parts)
    # Inside an article all of a name has to be such words, and an id more than a topic.
    said = [p - {x for x in p if x.isdigit()} for p in parts]
    told = [p <= LABELS | SHAPES and not p.isdisjoint(LABELS) for p in said]
    return any(told[:-1]) or told[-1] and not said[-1] <= TOPICS


class _Open:
    """The open elements, with the places of each tag, so that no tag is looked for element by element."""

    def __init__(self):
        self.stack, self.places = [0], defaultdict(list)

    def push(self, node: int, tag: str) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, place: int, nodes: list[Node]) -> None:
        for node in reversed(self.stack[place:]):
            self.places[nodes[node].tag].pop()
        del self.stack[place:]

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of the tags, 0 if none is open."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)


def parse(source: str) -> Page:
    """Blocks of a page in order, each with the node it stands in. Unclosed and misnested tags are taken as they come."""
    page, opened = Page([Node("body", -1)]), _Open()
    nodes, stack, links = page.nodes, opened.stack, 0
    text: list[str] = []
    linked = 0
    last_tag_end = source.rfind(">")
    endless: set[str] = set()  # tags that nothing ahead closes

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        node = nodes[stack[-1]]
        if words and not node.dropped:
            page.blocks.append((stack[-1], words))
            node.chars += len(words)
            node.own += len(words)
            node.link_chars += min(linked, len(words))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    def close(names: Iterable[str], until: Iterable[str]) -> None:
        place = opened.last(names)
        if place > opened.last(until):
            flush()
            opened.cut(place, nodes)

    def past(tag: str, end: str, at: int, missing: int) -> int:
        """Where an element's end tag ends, or ``missing``."""
        if tag in endless:
            return missing
        stop = re.compile(rf"</{tag}{end}", re.IGNORECASE).search(source, at)
        if stop is None:
            endless.add(tag)
            return missing
        return stop.end()

    at = 0
    while True:
        m = _TOKEN.search(source, at) if at <= last_tag_end or source.find("<!--", at) >= 0 else None
        if m is None:
            add(source[at:])
            break
        add(source[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag not in INLINE and tag not in VOID:
                close((tag,), ())
            continue
        if tag in RAW:
            flush()
            at = past(tag, r"(?=[\s/>])[^>]*+>", at, len(source))
            continue
        if tag in ("br", "hr"):
            text.append(" ")
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in INLINE and not (len(m["rest"]) > 8 and _drops(tag, m["rest"], True)):
            if tag == "a":
                links += 1
                nodes[stack[-1]].link_tags += 1
                nodes[stack[-1]].tags += 1
            continue
        flush()
        links = 0
        if tag in CLOSES:
            close(*CLOSES[tag])
        elif tag not in INLINE:
            close(("p",), P_ENDS)
        if tag in ARTICLES and nodes[stack[-1]].dropped:  # an unclosed menu or header doesn't swallow the article
            around = [i for name in ("nav", "header", "head", "form") for i in opened.places[name] if nodes[stack[i]].dropped]
            if around:
                opened.cut(min(around), nodes)
        up = nodes[stack[-1]]
        nodes.append(Node(tag, stack[-1], up.dropped or _drops(tag, m["rest"], opened.last(ARTICLES) > 0)))
        if tag in INLINE:  # a labelled span is a block of its own, left out at once if its end can be found
            at = past(tag, r"\s*>", at, at)
        else:
            opened.push(len(nodes) - 1, tag)
    flush()
    return page


def _measure(nodes: list[Node]) -> None:
    """Sums over subtrees, densities, and sums of the children's densities."""
    for i in range(len(nodes) - 1, 0, -1):
        node = nodes[i]
        if not node.dropped:
            up = nodes[node.parent]
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    body = nodes[0]
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        node.density = _density(node.chars, node.link_chars, node.tags, node.link_tags, share)
        node.total = _density(node.own, min(node.link_chars, node.own), 1, 1 if node.link_chars else 0, share) if node.own else 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if not nodes[i].dropped:
            nodes[nodes[i].parent].total += nodes[i].density


def _density(chars: int, link_chars: int, tags: int, link_tags: int, share: float) -> float:
    """Characters per tag, on a log scale of how little of them is links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    plain = max(1, chars - link_chars)
    base = math.log(math.log(chars / plain * links + share * chars + math.e))
    return chars / tags * max(0.0, math.log(max(1.0, chars / links * tags / link_tags))) / max(base, 0.05)


def _below(nodes: list[Node]) -> list[int]:
    """For every node the one with the highest sum in its subtree, the first of equals."""
    best = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        up, mine = nodes[i].parent, best[i]
        if not nodes[i].dropped and (nodes[mine].total, -mine) > (nodes[best[up]].total, -best[up]):
            best[up] = mine
    return best


def _marked(nodes: list[Node], roots: set[int]) -> list[bool]:
    """Which nodes are in ``roots`` or below one of them."""
    marks = []
    for i, node in enumerate(nodes):
        marks.append(i in roots or node.parent >= 0 and marks[node.parent])
    return marks


def extract(source: str) -> str:
    """The main text: white space inside a block is one space, and so is what joins blocks."""
    page = parse(source)
    nodes = page.nodes
    if not page.blocks:
        return ""
    _measure(nodes)
    below = _below(nodes)
    best = below[0]
    path = [best]
    while nodes[path[-1]].parent >= 0:
        path.append(nodes[path[-1]].parent)
    least = min(nodes[i].density for i in path)
    dense = [not node.dropped and node.density >= least for node in nodes]
    text = _marked(nodes, {below[i] for i in range(len(nodes)) if dense[i]})
    article = next((i for i in path if nodes[i].tag in ARTICLES), None)
    if article is None:
        return " ".join(block for node, block in page.blocks if text[node])
    # Articles beside it, but not around it.
    others = {i for i, node in enumerate(nodes) if node.tag == nodes[article].tag and dense[i] and i not in path}
    inside = _marked(nodes, {article} | others)
    return " ".join(
        block for node, block in page.blocks if inside[node] and (text[node] or nodes[node].tag in HEADINGS)
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(source.as_py() or "") for source in batch["html"]]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html, anything else).

    A null or empty page, or one without any main text, gives an empty text. Repeated rows each give a row.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_run, f"page_id {kind}, url string, text string, n_chars long")
