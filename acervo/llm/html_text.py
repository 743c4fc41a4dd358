"""Main text of raw web pages, by smoothed text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into
lines. Each line has a text-to-tag ratio. The ratios are smoothed with a
Gaussian, and a threshold between their two clusters (one-dimensional two-means)
marks content lines, outside menus, headers, footers, sidebars, notices, adverts,
forms and comments. The regions are the elements that hold marked text: article
and main elements bound a region each; of what no such element bounds, the deepest
element that holds all of it and blocks of the same kind beside it. All regions are returned in page order.
In a region, lists of links stay only where they are marked.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import columns, text_batches

SILENT = {"script", "style", "noscript", "template", "iframe", "svg", "head", "title", "object", "canvas", "math", "audio", "video"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "fieldset", "datalist"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PIECES = HEADINGS | {"p", "li", "pre", "blockquote", "td", "th", "tr", "dd", "dt", "hr"}  # hold a line or few, and are no region
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An opening tag of the key ends an open element of the value, within the element named last.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
WRAPPERS = {"html", "body", "main"}
COMMENT_NAMES = {"comment", "comments", "reply", "replies", "disqus", "respond", "responses", "discussion"}
NAMES = COMMENT_NAMES | {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adslot", "banner", "banners", "sponsor", "sponsored",
    "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "sidebar", "rail", "widget", "widgets", "related", "recommended",
    "recommendations", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "topbar", "toolbar",
    "header", "masthead", "footer", "copyright", "pagination", "pager", "search", "skip", "complementary", "contentinfo", "form",
}
#: Within an article a name is furniture only as a whole: of words above and words that say nothing of their own.
PLAIN_NAMES = {
    "section", "list", "box", "area", "block", "container", "wrapper", "wrap", "inner", "outer", "bar", "links", "link", "item", "items", "panel",
    "group", "button", "buttons", "icons", "icon", "top", "bottom", "left", "right", "posts", "articles", "stories", "site", "page", "unit", "slot", "row",
}
READER_NAMES = {"comment", "comments", "disqus", "respond", "replies"}  # reader comments by any word of a name
MORE = {"more", "also", "read", "reading", "you", "may", "might", "like", "see", "tags", "this", "us", "follow", "our", "on", "from", "the", "topics", "latest", "next", "previous"}
LEADS = {"lead", "lede", "intro", "summary", "abstract", "standfirst", "subtitle", "subheading", "dek", "deck", "tagline", "excerpt", "teaser"}
TOKEN = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SMOOTHING = 2.0  # standard deviation of the Gaussian, in lines
SHARE = 0.7  # of the marked text of a main element that its articles must hold to take its place
LINKED = 0.8  # of a line's text in links: a line of links
FEED = 1 << 16


class Element:
    __slots__ = ("tag", "parent", "odd", "lead", "holds", "order")

    def __init__(self, tag: str, parent: Element | None, odd: bool, order: int, lead: bool = False):
        self.tag, self.parent, self.odd, self.order, self.lead = tag, parent, odd, order, lead
        self.holds = False  # an article or main element lies inside


class Line:
    __slots__ = ("parts", "tags", "linked", "element")

    def __init__(self, element: Element):
        self.parts: list[str] = []
        self.tags, self.linked, self.element = 0, 0, element


class PageReader(HTMLParser):
    """Collects lines of text with the element each stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Element("", None, False, 0)
        self.open: list[Element] = [self.top]
        self.counts: dict[str, int] = {}  # open elements by tag
        self.elements, self.lines = [self.top], [Line(self.top)]
        self.silent = self.links = 0

    def _cut(self) -> None:
        line = self.lines[-1]
        if line.parts:
            self.lines.append(Line(self.open[-1]))
        else:
            line.element = self.open[-1]

    def _pop(self, to: int) -> None:
        """Close the open elements from place `to` on."""
        for e in self.open[to:]:
            self.counts[e.tag] -= 1
            self.silent -= e.tag in SILENT
            self.links -= e.tag == "a"
        block = any(e.tag in BLOCKS for e in self.open[to:])
        del self.open[to:]
        if block:
            self._cut()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            for place in range(len(self.open) - 1, 0, -1):  # a paragraph ends where a block begins
                if self.open[place].tag == "p":
                    self._pop(place)
                    break
                if self.open[place].tag in BLOCKS:
                    break
        if tag in IMPLIED and any(self.counts.get(t) for t in IMPLIED[tag][0]):
            ends, within = IMPLIED[tag]
            first = 0
            for place in range(len(self.open) - 1, 0, -1):
                if self.open[place].tag in within:
                    break
                if self.open[place].tag in ends:
                    first = place
            if first:
                self._pop(first)
        if tag == "body" and self.counts.get("head"):
            self._pop(next(i for i, e in enumerate(self.open) if e.tag == "head"))
        if tag in VOID:
            if tag in BLOCKS:
                self._cut()
            elif tag == "br":
                self.lines[-1].parts.append(" ")
            self.lines[-1].tags += 1
            return
        odd, lead = self._named(tag, attrs, bool(self.counts.get("article")))
        e = Element(tag, self.open[-1], odd, len(self.elements), lead)
        if tag in ("article", "main") and not e.odd:
            up = e.parent
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        self.elements.append(e)
        self.open.append(e)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"
        if tag in BLOCKS:
            self._cut()
        if tag not in SILENT:
            self.lines[-1].tags += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash, but on foreign elements
        if tag in SILENT - {"script", "style", "title", "iframe"} and self.open[-1].tag == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if not self.silent or tag in SILENT:
            self.lines[-1].tags += 1
        if not self.counts.get(tag):
            return  # nothing of that name is open
        for place in range(len(self.open) - 1, 0, -1):
            if self.open[place].tag == tag:
                self._pop(place)
                return
            if tag not in BLOCKS and self.open[place].tag in BLOCKS:
                return  # a stray inline end tag closes no block

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        line = self.lines[-1]
        line.parts.append(data)
        if self.links:
            line.linked += len(data.strip())

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, bool]:
        """Whether the element is page furniture by its tag, names or role, and whether it is named as an article's lead."""
        if tag in FURNITURE:
            return True, False
        if tag in WRAPPERS or tag not in BLOCKS and tag not in ("span", "a", "ins"):
            return False, False
        names: list[set[str]] = []
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += [set(TOKEN.findall(CAMEL.sub(" ", name).lower())) for name in value.split()]
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                return True, False
            elif key == "style" and value and "display:none" in value.replace(" ", "").lower():
                return True, False
        words = set().union(*names)
        lead = bool(words & LEADS)
        if tag in ("article", *HEADINGS):
            return bool(words & COMMENT_NAMES), lead
        if not in_article:
            return bool(words & NAMES), lead
        return bool(words & READER_NAMES) or any(n & NAMES and n <= NAMES | PLAIN_NAMES for n in names), lead


def smoothed(ratios: list[float], width: float = SMOOTHING) -> list[float]:
    """Gaussian smoothing along the lines; the ends weigh what is there."""
    reach = math.ceil(3 * width)
    kernel = [math.exp(-0.5 * (k / width) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        low, high = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[low - i + reach : high - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high])) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """The middle between two clusters on a line; equal values are all above."""
    low, high = min(values), max(values)
    for _ in range(30):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not under or not over:
            return low
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str) -> str:
    """Main text of one page: its blocks joined by line ends, empty where there is none."""
    reader = PageReader()
    for at in range(0, len(html), FEED):
        reader.feed(html[at : at + FEED])
    reader.close()
    lines = [(line, text) for line in reader.lines if (text := " ".join("".join(line.parts).split()))]
    if not lines:
        return ""
    elements = reader.elements
    outside = [False] * len(elements)  # in page furniture
    named = [False] * len(elements)  # an article or main element, or in one
    for e in elements[1:]:
        up = e.parent.order
        own = e.odd and not e.holds and not (e.tag == "header" and named[up])  # an article's own header: its headings stay, see below
        outside[e.order], named[e.order] = own or outside[up], e.tag in ("article", "main") or named[up]
    marks = smoothed([len(text) / max(1, line.tags) for line, text in lines])
    cut = threshold(marks)
    mass = _summed(elements, ((line.element, len(text)) for (line, text), mark in zip(lines, marks) if mark >= cut and not outside[line.element.order]))
    if not mass[0]:  # only furniture is above the threshold: count what is below
        mass = _summed(elements, ((line.element, len(text)) for line, text in lines if not outside[line.element.order]))
    byline = [False] * len(elements)  # in an article's own header, but no heading and no lead
    for e in elements[1:]:
        byline[e.order] = e.tag == "header" or byline[e.parent.order] and e.tag not in HEADINGS and not e.lead
    content = [(line, text, mark) for (line, text), mark in zip(lines, marks) if not outside[line.element.order] and not byline[line.element.order]]
    plain = _summed(elements, ((line.element, len(text)) for line, text, _ in content if line.linked < LINKED * len(text)))  # no link
    first = [False] * len(elements)  # an article in no other, nor in furniture
    within = [False] * len(elements)
    for e in elements[1:]:
        within[e.order] = e.parent.tag == "article" or within[e.parent.order]
        first[e.order] = e.tag == "article" and not outside[e.order] and not within[e.order]
    articles = _summed(elements, ((e, 1) for e in elements if first[e.order]))
    in_articles = _summed(elements, ((e, mass[e.order]) for e in elements if first[e.order]))
    bounds: list[Element | None] = [None] * len(elements)  # the named region an element stands in
    for e in elements[1:]:
        k = e.order
        bounds[k] = bounds[e.parent.order]
        if e.tag in ("article", "main") and not outside[k] and bounds[k] is None and (mass[k] or plain[k]):
            if e.tag == "article" or not articles[k] or in_articles[k] < SHARE * mass[k]:
                bounds[k] = e
    unbound = mass[0] - sum(mass[e.order] for e in set(bounds) - {None})
    loose: list[int] = []
    if unbound > (1 - SHARE) * mass[0]:  # no element names that text: the marked stretch, and no lists of links
        loose = [i for i, (line, _, _) in enumerate(content) if bounds[line.element.order] is None]
        loose = _stretch(elements, [content[i] for i in loose], loose, cut)
    kept = _without_link_lists(content, bounds, cut)
    return "\n".join(content[i][1] for i in sorted(kept.union(loose)))


def _summed(elements: list[Element], amounts: Iterator[tuple[Element, int]]) -> list[int]:
    """For each element the amounts given for it and for all inside it; elements come after those they stand in."""
    total = [0] * len(elements)
    for e, n in amounts:
        total[e.order] += n
    for e in reversed(elements[1:]):
        total[e.parent.order] += total[e.order]
    return total


def _without_link_lists(content: list[tuple[Line, str, float]], bounds: list[Element | None], cut: float) -> set[int]:
    """Places of the lines in named regions, but for unmarked lists of links where a region begins or ends.

    Headings that are links, a paragraph that is one, and lists of sources within the text stay.
    """
    regions: dict[int, list[int]] = {}
    for i, (line, _, _) in enumerate(content):
        if (region := bounds[line.element.order]) is not None:
            regions.setdefault(region.order, []).append(i)
    kept: set[int] = set()
    for places in regions.values():
        low, high = 0, len(places)

        def listed(i: int) -> bool:
            line, text, mark = content[i]
            return line.linked >= LINKED * len(text) and mark < cut and _in_list(line.element)

        while low < high and listed(places[low]):
            low += 1
        while high > low and listed(places[high - 1]):
            high -= 1
        kept.update(places[low:high])
        if 0 < high < len(places) and low < high and _said(content[places[high - 1]]):
            kept.update(places[high:])  # what the heading before announces
    return kept


def _in_list(e: Element | None) -> bool:
    """In a list item or a block without words of its own kind, such as a bare line of links; headings and paragraphs are neither."""
    while e is not None and e.tag not in BLOCKS:
        e = e.parent
    return e is not None and e.tag not in HEADINGS and e.tag != "p"


def _said(part: tuple[Line, str, float]) -> bool:
    """A heading that announces something of the article's own."""
    e = part[0].element
    while e is not None and e.tag not in BLOCKS:
        e = e.parent
    return e is not None and e.tag in HEADINGS and not set(TOKEN.findall(part[1].lower())) <= NAMES | PLAIN_NAMES | MORE


def _stretch(elements: list[Element], lines: list[tuple[Line, str, float]], places: list[int], cut: float) -> list[int]:
    """Places of the lines from the first marked one to the last, with the headings and plain lines before and after it in the element that holds the marked ones."""
    marked = [line.element for line, _, mark in lines if mark >= cut] or [line.element for line, _, _ in lines]
    inside = _summed(elements, ((e, 1) for e in marked))
    region = marked[0]
    while region.parent is not None and (region.tag not in BLOCKS or region.tag in PIECES or inside[region.order] < len(marked)):
        region = region.parent
    regions = {region.order}
    if region.tag in BLOCKS - WRAPPERS - PIECES:  # blocks beside it of the same kind that hold plain paragraphs, as a page of several articles has them
        top: list[Element | None] = [None] * len(elements)  # the block beside the region that an element stands in
        piece = [False] * len(elements)  # a paragraph or heading, or in one, within that block
        for e in elements[1:]:
            k, starts = e.order, e.parent is region.parent
            top[k] = e if starts else top[e.parent.order]
            piece[k] = e.tag == "p" or e.tag in HEADINGS or not starts and piece[e.parent.order]
        beside: dict[int, list[int]] = {}  # text, that which is no link, paragraphs and headings
        for line, text, _ in lines:
            e = top[line.element.order]
            if e is not None and e.tag == region.tag:
                found = beside.setdefault(e.order, [0, 0, 0])
                found[0] += len(text)
                found[1] += len(text) - min(line.linked, len(text))
                found[2] += piece[line.element.order]
        regions |= {k for k, (n, own, pieces) in beside.items() if pieces and own >= SHARE * n}
    chosen = [e.order in regions for e in elements]
    for e in elements[1:]:
        chosen[e.order] |= chosen[e.parent.order]
    held = [k for k, (line, _, _) in enumerate(lines) if chosen[line.element.order]]
    ends = [k for k in held if lines[k][2] >= cut]
    first, last = (ends[0], ends[-1]) if ends else (held[0], held[-1])
    while first > held[0] and (lines[first - 1][0].element.tag in HEADINGS or lines[first - 1][0].linked == 0):
        first -= 1
    while last < held[-1] and lines[last + 1][0].linked == 0:
        last += 1
    return [places[k] for k in range(first, last + 1) if lines[k][0].linked < LINKED * len(lines[k][1]) or lines[k][2] >= cut]


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, `text` and `n_chars` (its code points), one row per input row.

    A null or empty page, or one without main text, has the empty text.
    Character references are decoded, white space within a block becomes one
    space, blocks are joined by one line end. Repeated rows are read each; other columns are
    left out, also where they are named text or n_chars. The whole page is read, whatever its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "_html"):
            found = [main_text(t.decode("utf-8", "replace")) if t else "" for t in texts]
            yield columns(batch, list(keep), {"text": pa.array(found, pa.string()), "n_chars": pa.array([len(t) for t in found], pa.int64())})

    rows = pages.select(*(F.col(c) for c in keep), F.col(html).cast("string").alias("_html"))
    fields = [rows.schema[c] for c in keep] + [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]
    return rows.mapInArrow(run, T.StructType(fields))
