"""The main text of web pages: text-to-tag ratios of lines, smoothed and clustered by a threshold.

The parser's events are turned into lines as they stream by, one for each block of the page, with
their text, tags and container. What the markup itself names as something else than content (menus,
forms, adverts, ...) has no text. The ratios of text to tags are smoothed over neighbouring lines,
and lines above a threshold mark where the content is; the element that holds them is the region,
and all of its lines come out, short ones too.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Fixed values of HTML: elements without content, elements that begin a line, elements whose text isn't shown as text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section "
    "select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Elements that say nothing about where the content is.
PLAIN = set("p a b i em strong span u s small sub sup code font".split())
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
HIDDEN = set("head script style noscript template title svg iframe object canvas audio video map nav footer aside form button select textarea datalist menu dialog search".split())
#: Elements that an element of these kinds ends, where it is still open.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tablist".split())

#: Words of class names and ids that name something else than content: whole words, then beginnings.
LABELS = set("ad ads adv nav navs header aside login signup share shares sharing social tags toc hidden skip promo reply replies respond responses".split())
LABEL_STARTS = tuple("advert sponsor breadcrumb cookie consent newsletter subscri popup modal overlay sidebar navbar navig footer disqus comment widget related recommend masthead banner menu toolbar topbar pagination pager notice notification alert copyright disclaimer discussion".split())
#: Names with one of these words only say what is or isn't elsewhere, as in "no-sidebar".
ABOUT = {"no", "not", "has", "with", "without", "is"}
_WORD, _NAME = re.compile(r"[a-z]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")


def labelled(names: str) -> bool:
    """Whether one of the class names or ids begins or ends with a word that names no content."""
    for name in names.split():
        parted, whole = _WORD.findall(_NAME.sub("-", name).lower()), _WORD.findall(name.lower())
        if whole and not ABOUT.intersection(parted) and any(x in LABELS or x.startswith(LABEL_STARTS) for w in (parted, whole) for x in (w[0], w[-1])):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, characters in links, tags, container) of each line of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.up, self.kind = [-1], [""]  # containers: the one around, and main, article or nothing
        self.open_: list[tuple] = []  # an open element's tag, and what here, hidden, ... were before it
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # where in open_ elements that begin a line are
        self.here, self.hidden, self.heading, self.head = 0, 0, 0, 0
        self.article, self.named = 0, False  # inside main: 1, an article: 2; whether the page has any
        self.pieces, self.linked, self.tags = [], 0, 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.rawdata.find(">", i) + 1 or -1  # a comment, in web pages

    def finish(self) -> None:
        """The end of the page: a tag or comment that it cuts off is no text, other text that waited is."""
        if not self.cdata_elem and not self.rawdata.startswith("<"):
            self.handle_data(unescape(self.rawdata))
        self.line()

    def line(self) -> None:
        text = " ".join("".join(self.pieces).split()) if self.pieces else ""
        if text or self.tags:
            self.lines.append((text, self.linked, self.tags, self.here))
        self.pieces, self.linked, self.tags = [], 0, 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and (not self.head or self.heading):
            self.pieces.append(data)
            if self.at["a"]:
                self.linked += len(data.strip())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            if self.at["p"]:
                self._end(self.at["p"][-1])
            for t in ENDS.get(tag, ()):
                if self.at[t] and self.at[t][-1] > max([*self.at["ul"][-1:], *self.at["ol"][-1:], *self.at["table"][-1:], *self.at["dl"][-1:], *self.at["select"][-1:]], default=-1):
                    self._end(self.at[t][-1])
            self.line()
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        if tag in BLOCK:
            self.blocks.append(len(self.open_))
        self.at[tag].append(len(self.open_))
        self.open_.append((tag, self.here, self.hidden, self.heading, self.head, self.article))
        if tag in PLAIN and not attrs:
            return
        a = {k: v or "" for k, v in attrs} if attrs else {}
        content = tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop") == "articleBody"
        names = f"{a.get('class', '')} {a.get('id', '')}" if a else ""
        style = a.get("style", "").replace(" ", "").lower()
        unseen = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        if tag in HIDDEN or unseen or a.get("role", "").lower() in ROLES:
            self.hidden = 2
        elif tag == "header" or (names and tag not in ("html", "body", "main") and labelled(names)):
            if self.article and (tag == "header" or "header" in names.lower()):
                self.head = 1  # an article's own header: its headings are content
            elif not (content and tag == "article" and not labelled(names)):
                self.hidden = max(self.hidden, 1)
        elif content:
            if self.article == 2 and tag == "article":
                self.hidden = 2  # an article within an article is a reader's comment
            elif self.hidden == 1 and not self.named:
                self.hidden = 0  # what was only named so by a class, and left open or around everything
        if tag in HEADING:
            self.heading = 1
        if tag in BLOCK and tag not in HEADING and tag != "p":
            self.up.append(self.here)
            self.kind.append(("main" if tag == "main" or a.get("role", "").lower() == "main" else "article") if content and not self.hidden else "")
            self.here = len(self.up) - 1
            if self.kind[-1]:
                self.named = True
                self.article = max(self.article, 1 + (self.kind[-1] == "article"))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            if self.at[tag]:
                self._end(self.at[tag][-1])
            self.line()
        elif tag == "br":
            self.pieces.append(" ")
        elif self.at[tag] and (not self.blocks or self.at[tag][-1] > self.blocks[-1]):
            self._end(self.at[tag][-1])
        self.tags += 1

    def _end(self, at: int) -> None:
        """Closes this open element and all within it."""
        if self.blocks and self.blocks[-1] >= at:
            self.line()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        while len(self.open_) > at:
            tag, self.here, self.hidden, self.heading, self.head, self.article = self.open_.pop()
            self.at[tag].pop()


def smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    """With a Gaussian over the neighbouring lines; at the ends over those that there are."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(x, kernel)[reach : reach + len(x)] / np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]


def main_lines(page: Lines, sigma: float) -> list[str]:
    """The texts of the lines in the region that the marked lines are in."""
    lines, up, kind = page.lines, page.up, page.kind
    size = np.array([len(t) for t, *_ in lines], float)
    if not size.any():
        return []
    ratio = smoothed(size / np.maximum([n for _, _, n, _ in lines], 1), sigma)
    marked = (ratio >= ratio.std()) & (size > 0)
    if not marked.any():
        marked = size > 0
    # the marked text within each container, from the inner ones outwards: containers are numbered as they open
    weight = np.zeros(len(up))
    np.add.at(weight, [c for *_, c in lines], size * marked)
    for c in range(len(up) - 1, 0, -1):
        weight[up[c]] += weight[c]
    inside = np.zeros(len(up), bool)  # in the region
    for want in ("article", "main"):
        found = [c for c in range(len(up)) if kind[c] == want]
        outer = outermost(found, up)
        if outer and sum(weight[c] for c in outer) >= 0.5 * weight[0]:
            most = max(weight[c] for c in outer)
            inside[[c for c in outer if weight[c] >= 0.25 * most]] = True
            break
    named = inside.any()
    if not named:  # the innermost container with nearly all of the marked text
        inside[max(c for c in range(len(up)) if weight[c] >= 0.9 * weight[0])] = True
    for c in range(1, len(up)):
        inside[c] |= inside[up[c]]
    # no element says where the content is: lists of links between its lines are menus
    menu = lambda k: not named and not marked[k] and lines[k][1] * 2 > size[k]
    return [t for k, (t, _, _, c) in enumerate(lines) if t and inside[c] and not menu(k)]


def outermost(found: list[int], up: list[int]) -> list[int]:
    """Of these containers those that are in no other of them."""
    within = np.zeros(len(up), bool)
    within[found] = True
    for c in range(1, len(up)):
        within[c] |= within[up[c]]
    return [c for c in found if c == 0 or not within[up[c]]]


def text_of(html: str, sigma: float = 1.0) -> str:
    page = Lines()
    page.feed(html)
    page.finish()
    return " ".join(main_lines(page, sigma))


def main_text(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """(page_id, url, html, ...) -> (page_id, url, text): the main text of every page.

    Character references are decoded, white space within a block is one space, blocks are joined by one
    space in page order. Pages are read whole and one by one: null and empty ones and those without
    content have an empty text, repeated rows and null ids and urls come back as they are, other columns
    are ignored, an empty table gives an empty one. Elements that are left open or cut off end with what
    is around them or with the page. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                texts = [text_of(x.as_py(), sigma) if x.is_valid else "" for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string")


def op13_html_text(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


#: The same rows for pages whose article stands in one article element with no other elements but plain ones, as in the given tables.
OP13_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
