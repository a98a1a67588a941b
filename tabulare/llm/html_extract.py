"""Main text of HTML pages by minimum-cut labelling of text blocks.

The page is cut into blocks, the runs of text between block-level tags. A
linear classifier over each block's place and wording gives the cost of
calling it content and of calling it boilerplate; the two costs are the
block's terminal capacities. Neighbouring blocks, and blocks of one parent,
are joined by smoothness edges. The minimum cut (maximum flow) of that graph
is the labelling of least total cost; blocks on the source side are content.

A block's place is the chain of elements above it that say something about
their text: ``main`` and ``article``, boxes named by tag, role or class
(sidebar, menu, comments), headers. Such a name is a cost in the cut and no
veto. It does not count against the page's ``main``, or its only article,
inside the box, nor where the box is the page (``LAYOUT_SHARE`` of its words)
and nothing outside it is marked as main. Only readers' comments keep an
article, and text that is hidden is no block.

Pages are independent: each is worked on where it is read, without a
shuffle, in time linear in its size but for the flow, which is local.

Character references are decoded, white space inside a block becomes one
space, blocks are joined by a newline in page order; nothing is capped.
Scripts, styles and other text that is never shown are no blocks at all.

Defined results for odd input: NULL, empty and markup-only pages have an
empty text; unclosed tags, comments and quotes end as a browser would end
them, at the latest with the page; repeated rows give equal texts; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.S)

RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
UNSEEN = {"svg", "math", "canvas", "object", "audio", "video", "select", "button", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
         "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
         "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search",
         "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | RAW | UNSEEN
# a start tag of the key ends an open element of the values, within the nearest element of SCOPE
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}, "option": {"option"}, "body": {"head"}}
ENDED = frozenset().union(*ENDS.values())
SCOPE = {"ul", "ol", "dl", "menu", "dir", "table", "select", "datalist"}
ASIDE = {"nav", "aside", "footer", "menu", "dialog", "search"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu"}
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
               "consent", "cookie", "cookies", "copyright", "footer", "gdpr", "legal", "login",
               "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay",
               "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related",
               "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser",
               "toolbar", "topbar", "tracking", "widget", "widgets"}
COMMENT_WORDS = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond"}
HEADER_WORDS = {"header"}
LAYOUT_WORDS = {"with", "has", "no", "without"}          # "with-sidebar" names the layout
NEUTRAL_TAGS = {"html", "body", "main", "article"}       # their classes name the layout, not their role
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "dd", "dt", "figcaption"}
LAYOUT_SHARE = 0.8
MAIN, ARTICLE, BOX, NAMED_BOX, NAMED_TEXT, COMMENTS, HEADER = range(7)
_WORDS = re.compile(r"[a-z]+")
_PHRASE = re.compile(r"©|\(c\) \d|all rights reserved|privacy policy|terms of (?:use|service)|cookies?\b|subscribe|sign (?:up|in)|"
                     r"log ?in\b|newsletter|advertisement|sponsored", re.I)

# the classifier: log-odds of content
BIAS, IN_MAIN, OUTSIDE_MAIN = -0.8, 3.0, -3.0
PLACE_ODDS = {BOX: -9.0, NAMED_BOX: -9.0, NAMED_TEXT: -4.0, COMMENTS: -12.0, HEADER: -4.0}
TAG_ODDS = {"p": 1.0, "blockquote": 1.0, "pre": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5, "h4": 0.5, "li": -0.5, "td": -0.3, "option": -3.0}
PER_WORD, MOST_WORDS, SENTENCE, LINKS, LINKS_IN_MAIN, PHRASE = 0.1, 30, 0.5, -5.0, -2.0, -3.0
# smoothness: next to each other, in one parent, and of one tag in one parent with others between
NEXT, NEXT_SIBLING, SAME_PARENT = 0.3, 1.0, 0.5


class Place:
    """An element that says something about the text below it; ``above`` is the next such element."""

    __slots__ = ("kind", "above", "words", "layout")

    def __init__(self, kind, above):
        self.kind, self.above, self.words, self.layout = kind, above, 0, False


@dataclass
class Block:
    text: str
    words: int
    place: Place | None
    tag: str
    parent: int
    link_share: float


class _Element:
    __slots__ = ("tag", "place", "links", "unseen", "number", "block", "parent", "items")

    def __init__(self, tag, place, links, unseen, number, above=None):
        self.tag, self.place, self.links, self.unseen, self.number = tag, place, links, unseen, number
        # the nearest block element, what is right above that, and the items open in this list or table
        inside = above is not None and tag not in BLOCK
        self.block, self.parent = (above.block, above.parent) if inside else (self, above.number if above else 0)
        items = above.items if above and tag not in SCOPE else frozenset()
        self.items = items | {tag} if tag in ENDED else items


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by name, each with its own value; of two of one name the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        out.setdefault(name.lower(), html.unescape(a or b or c).lower())
    return out


def _hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs and attrs["hidden"] != "until-found" or bool(
        re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")))


def _kind(tag: str, attrs: dict[str, str]) -> int | None:
    """What an element says about its text, if anything."""
    role = attrs.get("role", "")
    if tag == "main" or role == "main":
        return MAIN
    if tag == "article" or role == "article":
        return ARTICLE
    names: set[str] = set()
    if tag not in NEUTRAL_TAGS:
        for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
            words = set(_WORDS.findall(name))
            if not words & LAYOUT_WORDS:
                names |= words
    if names & COMMENT_WORDS:
        return COMMENTS
    if tag in ASIDE or role in ASIDE_ROLES:
        return BOX
    if tag not in BLOCK:
        return None
    if tag == "form":
        return NAMED_BOX
    if names & ASIDE_WORDS or attrs.get("aria-hidden") == "true":
        return NAMED_TEXT if tag in TEXT_TAGS else NAMED_BOX
    return HEADER if tag == "header" or names & HEADER_WORDS else None


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order."""
    out: list[Block] = []
    root = _Element("", None, 0, False, 0)
    stack, opened = [root], {}
    text: list[str] = []
    linked, total, holder, numbers = 0, 0, None, 0

    def flush():
        nonlocal linked, total, holder
        if holder is not None:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                out.append(Block(words, words.count(" ") + 1, holder.place, holder.tag, holder.parent, linked / total if total else 0.0))
        text.clear()
        linked, total, holder = 0, 0, None

    def say(piece: str):
        nonlocal linked, total, holder
        top = stack[-1]
        if top.unseen:
            return
        solid = len(piece) if not piece.isspace() else 0
        if solid and holder is None:
            holder = top.block
        text.append(piece)
        total += solid
        if top.links:
            linked += solid

    def close(tag: str):
        if opened.get(tag):
            while True:
                e = stack.pop()
                opened[e.tag] -= 1
                if e.tag == tag:
                    return

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if m["close"]:
            close(tag)
            continue
        if tag in BLOCK and tag not in RAW and opened.get("p"):
            close("p")
        for other in sorted(ENDS.get(tag, ())):
            if other in stack[-1].items:
                close(other)
        if tag in VOID or m["attrs"].endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "span", "strong"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        top = stack[-1]
        numbers += 1
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        kind = _kind(tag, attrs)
        stack.append(_Element(tag, top.place if kind is None else Place(kind, top.place), top.links + (tag == "a"),
                              top.unseen or tag in UNSEEN or _hidden(attrs), numbers, top))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def _above(place: Place | None) -> Iterator[Place]:
    while place is not None:
        yield place
        place = place.above


def _clean(place: Place) -> bool:
    """Whether nothing above a ``main`` or ``article`` speaks against it."""
    return all(p.layout or p.kind in (MAIN, ARTICLE, HEADER) for p in _above(place.above))


def find_layout(blocks: list[Block]) -> set[Place]:
    """The elements that hold the page's main text by their markup; boxes that are mere layout are marked."""
    mains, total = {}, 0
    for b in blocks:
        total += b.words
        for p in _above(b.place):
            p.words += b.words
            if p.kind in (MAIN, ARTICLE):
                mains[p] = None
    clean = [p for p in mains if _clean(p)]
    if not clean:                              # a box around the page is no box
        for b in blocks:
            for p in _above(b.place):
                if p.kind in (NAMED_BOX, NAMED_TEXT, BOX) and p.words >= LAYOUT_SHARE * total:
                    p.layout = True
        clean = [p for p in mains if _clean(p)]
    if not clean:                              # the page's main element, else its only article, wherever it is
        chosen = [p for p in mains if p.kind == MAIN]
        articles = [p for p in mains if not any(q.kind == COMMENTS for q in _above(p))]
        clean = chosen or (articles if len(articles) == 1 else [])
        for p in clean:
            for q in _above(p.above):
                q.layout = True
    return set(clean)


def _place_odds(place: Place | None, mains: set[Place]) -> tuple[float, bool]:
    """Log-odds of a block's place, and whether that is in the main text."""
    worst, inside, header = 0.0, False, False
    for p in _above(place):
        if p in mains:
            inside = True
        elif p.kind == HEADER:
            header = True
        elif not p.layout:
            worst = min(worst, PLACE_ODDS.get(p.kind, 0.0))
    if inside:                                 # an article's own header is its title
        return IN_MAIN + worst, True
    if header:
        worst = min(worst, PLACE_ODDS[HEADER])
    return worst or (OUTSIDE_MAIN if mains else 0.0), False


def content_odds(block: Block, mains: set[Place]) -> float:
    """Log-odds that a block is content."""
    place, inside = _place_odds(block.place, mains)
    odds = BIAS + place + TAG_ODDS.get(block.tag, 0.0) + PER_WORD * min(block.words, MOST_WORDS)
    odds += (LINKS_IN_MAIN if inside else LINKS) * block.link_share
    if block.text[-1] in ".!?…。":
        odds += SENTENCE
    if block.words < 25 and not inside and _PHRASE.search(block.text):
        odds += PHRASE
    return odds


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges ``(i, j, capacity)`` between blocks close to each other on the page and in the DOM."""
    edges, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            edges.append((j - 1, j, NEXT_SIBLING if blocks[j - 1].parent == b.parent else NEXT))
        i = last.get((b.parent, b.tag))
        if i is not None and i < j - 1:
            edges.append((i, j, SAME_PARENT))
        last[b.parent, b.tag] = j
    return edges


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Source side of the minimum cut; ``source[i]`` is lost if i is cut from the source, ``sink[i]`` if it is not.

    Breadth-first augmentation in phases (Dinic) over residual capacities;
    flow that can go straight through a node does so first.
    """
    n = len(source)
    to, cap, out = [], [], [[] for _ in range(n + 2)]
    s, t = n, n + 1

    def arc(u, v, c, back):
        out[u].append(len(to))
        to.append(v)
        cap.append(c)
        out[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):                         # straight through: only the difference is left
        d = source[i] - sink[i]
        if d > 0:
            arc(s, i, d, 0.0)
        elif d < 0:
            arc(i, t, -d, 0.0)
    for u, v, c in edges:
        arc(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        step = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while step[u] < len(out[u]):
                e = out[u][step[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                step[u] += 1
            if step[u] < len(out[u]):
                path.append(out[u][step[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                step[u] += 1


def main_text(page: str | None) -> str:
    """The article of a page."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    mains = find_layout(blocks)
    odds = [content_odds(b, mains) for b in blocks]
    soft = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    content = minimum_cut([soft(x) for x in odds], [soft(-x) for x in odds], smoothness(blocks))
    return "\n".join(b.text for b, c in zip(blocks, content) if c)


def extract(pages: DataFrame) -> DataFrame:
    """Per row ``page_id, url, text, n_chars``."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(
        run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
