"""Main text of web pages, from the standard library's parser events.

The events of a page become lines: the text between the tags that begin or end a block. A line knows its tags, its
characters in links, and the elements around it. Lines that the markup itself names as something else (menus, footers,
forms, adverts, comments; by element, class, id or role) are out. For the others:

1. text-to-tag ratio of each line: code points outside links by number of tags (at least one);
2. a Gaussian smooths the ratios over the lines (those that are out count as zero), so that a short line among long ones
   is high and a long one among menus is low;
3. two clusters, parted where the variance between them is largest, give the threshold above which lines are content.

Content lines make regions by the element they stand in. The region is the article (or main) element with most content; if
there is none, the innermost element that holds nearly all of it. All lines in it that aren't out belong to the text,
however short; in an element without name, parts at its edges or inside that have no content line and are mostly links don't.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

#: Elements whose text is never main text, whatever is in them; and those that a page uses for what is around it.
UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video select option textarea button datalist map".split())
AROUND = frozenset("nav aside footer form menu dialog header".split())
#: Elements that begin and end lines.
BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre section article main address figure figcaption details summary fieldset legend hgroup center hr search".split()
) | (UNSEEN - {"map"}) | AROUND
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of class names, ids and roles that name what isn't main text.
NAMES = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies dialog discussion disqus footer form gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion reader related replies respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: A class that begins so tells what a page has or lacks, not what the element is.
_ABOUT = ("has-", "with-", "no-", "without-", "is-", "not-")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])")
#: What a new element ends, if it is open up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements that an end tag of something outside doesn't reach into.
_WALLS = frozenset("article main section table td th aside nav footer header form body".split())

_PLAIN, _PLAIN_END, _COMMENT_END = re.compile("<([A-Za-z][A-Za-z0-9]*)>"), re.compile("</([A-Za-z][A-Za-z0-9]*)>"), re.compile("--!?>")

SIGMA = 1.5
#: The share of content that a region without name holds at least, and of links that makes a part a menu.
HOLDS, LINKED = 0.9, 0.5


def named_otherwise(attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role say that an element isn't main text, or it isn't shown."""
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return True
        if key in ("class", "id", "role") and value:
            for name in value.split():
                if not name.lower().startswith(_ABOUT) and any(part.lower() in NAMES for part in _PART.findall(name)):
                    return True
    return False


class _Element:
    __slots__ = ("article", "content", "inside", "named", "out", "parent", "size", "tag")

    def __init__(self, tag: str, parent: _Element | None, out: bool, named: bool):
        self.tag, self.parent, self.out, self.named = tag, parent, out, named
        self.article = self.inside = False  # article: holds an article or main element that isn't named otherwise
        self.size = self.content = 0


class _Line:
    __slots__ = ("links", "tags", "text", "within")

    def __init__(self, text: str, tags: int, links: int, within: _Element):
        self.text, self.tags, self.links, self.within = text, tags, links, within


class LineParser(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = _Element("", None, False, False)
        self.elements: list[_Element] = []
        self.depth: dict[str, int] = {}  # how many elements of a name are open, so that a stray end tag costs nothing
        self.lines: list[_Line] = []
        self.parts: list[str] = []
        self.tags = self.links = self.anchors = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(_Line(text, self.tags, min(self.links, len(text)), self.open))
                self.tags = 0
            self.parts, self.links = [], 0

    def push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = tag not in ("html", "body", "main") and named_otherwise(attrs)
        above = self.open
        inside = tag == "header" and any(self.depth.get(x) for x in ("article", "main"))  # an article's own header has its title
        out = tag in UNSEEN or (tag in AROUND and not inside)
        self.open = _Element(tag, above, out, named)
        self.elements.append(self.open)
        self.depth[tag] = self.depth.get(tag, 0) + 1
        if tag in ("article", "main") and not named:
            while above is not None and not above.article:
                above.article, above = True, above.parent

    def pop(self) -> None:
        self.depth[self.open.tag] -= 1
        self.open = self.open.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.open.tag == "p" or (tag in HEADINGS and self.open.tag in HEADINGS):
                self.pop()
            if tag in _CLOSES:
                gone, wall = _CLOSES[tag]
                at = self.open
                while at.parent is not None and at.tag not in gone and at.tag not in wall and at.tag not in _WALLS:
                    at = at.parent
                if at.tag in gone:
                    while self.open is not at.parent:
                        self.pop()
            if tag not in VOID:
                self.push(tag, attrs)
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.anchors = 1  # links don't nest
        elif tag not in VOID and attrs and named_otherwise(attrs):
            self.end_line()
            self.push(tag, attrs)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't end an element in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.anchors = 0
        if tag not in BLOCKS and not self.depth.get(tag):
            return
        self.end_line()
        if not self.depth.get(tag):
            return
        at = self.open
        while at.tag != tag:
            if at.tag in _WALLS and tag not in _WALLS and tag not in ("html", "div"):
                return  # an end tag of what is outside
            at = at.parent
        at = at.parent
        while self.open is not at:
            self.pop()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.anchors:
            self.links += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()

    # The whole page is there, so what isn't closed runs to its end, as browsers have it; the parser would look for the end
    # from every further place again. Plain tags are by far the most, and need no search for attributes.
    def parse_starttag(self, i: int) -> int:
        plain = _PLAIN.match(self.rawdata, i)
        if plain:
            tag = plain[1].lower()
            self.handle_starttag(tag, [])
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
            return plain.end()
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        plain = _PLAIN_END.match(self.rawdata, i)
        if plain and self.cdata_elem is None:
            self.handle_endtag(plain[1].lower())
            return plain.end()
        return len(self.rawdata) if self.rawdata.find(">", i) < 0 else super().parse_endtag(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    parse_pi = parse_html_declaration

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines of the source aren't counted


@lru_cache(maxsize=256)
def _kernel(sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    return np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Ratios smoothed by a Gaussian of ``sigma`` lines, normalised at the edges."""
    kernel = _kernel(sigma)
    reach = len(kernel) // 2
    middle = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]


def threshold(values: np.ndarray) -> float:
    """The value that parts two clusters with the largest variance between them; the least value of the upper one. All are one cluster if they are equal."""
    order = np.sort(values)
    n, cuts = len(order), np.flatnonzero(order[1:] > order[:-1]) + 1
    if not len(cuts):
        return float(order[0]) if n else 0.0
    below = np.cumsum(order)[cuts - 1]
    between = cuts * (n - cuts) * ((order.sum() - below) / (n - cuts) - below / cuts) ** 2
    return float(order[cuts[int(np.argmax(between))]])


def main_text(html: str | None) -> str:
    """The text of a page's article: its blocks in page order, joined by line ends; empty if there is none."""
    parser = LineParser()
    parser.feed(html or "")
    parser.close()
    lines, elements = parser.lines, parser.elements
    for e in elements:  # from the outside in
        e.out = e.out or e.parent.out or (e.named and not e.article)
    clear = [not x.within.out for x in lines]
    if not any(clear):
        return ""
    smooth = smoothed(np.array([(len(x.text) - x.links) / max(1, x.tags) if c else 0.0 for x, c in zip(lines, clear, strict=True)]))
    least = threshold(smooth[np.array(clear)])
    content = [c and s >= least and x.links < LINKED * len(x.text) for x, c, s in zip(lines, clear, smooth.tolist(), strict=True)]
    for x, c, good in zip(lines, clear, content, strict=True):
        if c:
            x.within.size += len(x.text)
            x.within.content += len(x.text) * good
    for e in reversed(elements):
        e.parent.size += e.size
        e.parent.content += e.content
    region = _region(parser.root, elements)
    _mark(region, elements)
    found = [i for i, x in enumerate(lines) if clear[i] and x.within.inside]
    if region.tag not in ("article", "main"):
        found = _without_menus(found, lines, content, region)
    return "\n".join(lines[i].text for i in found)


def _mark(region: _Element, elements: list[_Element]) -> None:
    """Sets which elements are in the region."""
    region.inside = True
    for e in elements:
        e.inside = e is region or e.parent.inside


def _region(root: _Element, elements: list[_Element]) -> _Element:
    named = [e for e in elements if e.tag in ("article", "main") and not e.out and e.size]
    if named:
        best = max(named, key=lambda e: (e.content, e.size))
        _mark(best, elements)
        inner = [e for e in named if e.inside and e is not best and e.tag == "article" and 2 * e.size > best.size]
        if inner:  # the innermost of those that hold most of it
            return min(inner, key=lambda e: e.size)
        others = [e for e in named if not e.inside]
        around = {best}
        e = best
        while e.parent is not None:
            e = e.parent
            around.add(e)
        others = [e for e in others if e not in around]
        if sum(e.size for e in others) <= best.size:
            return best
        for e in others:  # several articles of a page: what is around them
            while e not in around:
                e = e.parent
            while best is not e and best.parent is not None and e in _path(best):
                best = best.parent
        return best
    children: dict[_Element, _Element] = {}
    for e in elements:
        if e.size and not e.out and (e.parent not in children or e.content > children[e.parent].content):
            children[e.parent] = e
    region = root
    while region in children:
        best = children[region]
        if best.tag in ("p", "li", "td", "pre", *HEADINGS) or best.content < HOLDS * root.content:
            break
        region = best
    return region


def _path(e: _Element | None) -> Iterator[_Element]:
    while e is not None:
        yield e
        e = e.parent


def _without_menus(found: list[int], lines: list[_Line], content: list[bool], region: _Element) -> list[int]:
    """The lines without the region's parts that have no content line and are mostly links, or are no heading and lie outside of the content."""
    parts: list[tuple[_Element | None, list[int]]] = []
    for i in found:
        e = lines[i].within
        while e is not region and e.parent is not region:
            e = e.parent
        if e is region or not parts or parts[-1][0] is not e:
            parts.append((e, []))
        parts[-1][1].append(i)
    good = [any(content[i] for i in p) for _, p in parts]
    if not any(good):
        return found
    first, last = good.index(True), len(good) - 1 - good[::-1].index(True)
    out = []
    for at, (e, p) in enumerate(parts):
        linked = sum(lines[i].links for i in p) >= LINKED * sum(len(lines[i].text) for i in p)
        title = e is not None and e.tag in HEADINGS and at < first
        if good[at] or (first < at < last and not linked) or (title and not linked) or (e.tag == "p" and not linked and _joined(at, first, last, parts)):
            out += p
    return out


def _joined(at: int, first: int, last: int, parts: list[tuple[_Element | None, list[int]]]) -> bool:
    """Whether only paragraphs and headings are between a part and the content."""
    between = parts[at:first] if at < first else parts[last + 1 : at + 1]
    return all(e is not None and e.tag in ("p", *HEADINGS) for e, _ in between)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text, the main text of the whole page, and n_chars, its code points.

    Character references are decoded; white space inside a block becomes one space; blocks are joined by line ends in page
    order, nothing else is dropped. A null or empty page, or one without an article's text, has an empty text. Very long
    pages are read whole. Rows are independent, so repeated rows get equal results; an
    empty table gives an empty result. Columns of those names are replaced, others kept.
    """
    kept = pages.select(*[c for c in pages.columns if c not in ("text", "n_chars")]) if html_col not in ("text", "n_chars") else pages
    given = spread(kept.select(F.struct(*[c for c in kept.columns if c not in ("text", "n_chars")]).alias("_page"), F.col(html_col).alias("_html")))
    schema = T.StructType([given.schema["_page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["_page", "text", "n_chars"])

    return given.mapInArrow(run, schema).select("_page.*", "text", "n_chars")
