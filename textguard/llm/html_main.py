"""The main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events. Block elements end
lines; each line has its text and the number of tags in it. Text of links counts
as tags do: it has no weight. The logarithms of the ratios of text to tags are
smoothed by a Gaussian over neighbouring lines and clustered about a threshold
(two means); lines of the upper cluster mark content regions. A region is the
section that holds such a line, all of the article or main element around it
(alone, if articles hold most of what is found), and the lines between two of its
content lines; none of it is lost for being short. Outside articles, lines that are mostly links, those before the section
of the page's first heading, divisions of one line at the page's ends and a
copyright line are no content.

What the markup itself calls a menu, header, footer, sidebar, notice, advert,
form or comment, by element, role or a whole name in class or id, is no content
at any ratio. A division whose name begins or ends with such a word is none
either, unless it holds most of the page's text.

Pages are independent: no shuffle, one pass. Of a page, every event is handled
in constant time, taken over all events, whatever is left unclosed.

Defined cases: a null page is empty; an empty page or one without content has
an empty text; a page of one line is that line; unclosed and stray tags are
taken as browsers take them, as far as regions are concerned; repeated rows
get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    """address article aside blockquote body br canvas caption center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table
    tbody td tfoot th thead title tr ul video""".split()
)
SECTION = frozenset("article main section div td body blockquote".split())
#: Elements that are no content, roles, and words in class or id.
NOT_TEXT = frozenset("head title script style noscript template iframe object svg math canvas audio video select option button input textarea".split())
APART = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notification alert popup popover modal overlay newsletter subscribe subscription signup login search sidebar sidenav rail nav
    navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist
    disqus respond reply replies share sharing social related recommended widget skip""".split()
)
#: What an article may be called that is a reader's comment.
REPLIES = frozenset(["comment", "reply"])
HEADS = frozenset(["header"])
HOLDING = frozenset("footer aside form dialog section article".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th".split())
#: What in an article keeps its text whatever it is called, but for adverts.
PHRASES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th span a b i em strong q cite pre figcaption caption br".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: What a name with one of WORDS at its head or tail counts for.
DIVISIONS = frozenset("div section ul ol dl table center details fieldset".split())
#: A line with this share of its letters in links is one of links.
LINKED = 0.5
_COPYRIGHT = re.compile(r"\s*(?:©|\(c\)\s|copyright\b)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def standing(tag: str, attrs: dict[str, str | None], inside: bool) -> tuple[bool, bool]:
    """Whether an element stands beside the content, and whether its name makes that likely.
    ``inside``: an article or main holds it."""
    if tag in NOT_TEXT or tag in APART or attrs.get("hidden", 0) != 0 or (attrs.get("aria-hidden") or "") == "true":
        return True, False
    if tag in ("html", "body", "main"):
        return False, False
    if (attrs.get("role") or "").lower() in ROLES:
        return True, False
    names = set(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split())
    if tag == "article":
        return bool(names & REPLIES), False
    # an article's own header holds its title
    if names & (ADVERTS if inside and tag in PHRASES else WORDS) or not inside and (tag in HEADS or names & HEADS):
        return True, False
    likely = WORDS if inside else WORDS | HEADS
    parts = [_SPLIT.split(name.strip("-_")) for name in names] if tag in DIVISIONS else []
    return False, any(x[0] in likely or x[-1] in likely for x in parts)


class Element(NamedTuple):
    """An open element: what lines in it belong to, and the places in the stack of the
    nearest block and the nearest section that hold it (or are it)."""

    tag: str
    section: int
    out: bool
    article: int
    likely: int
    block: int
    frame: int


NONE = Element("", 0, False, 0, 0, -1, -1)


class Line(NamedTuple):
    text: str
    tags: int
    element: Element
    #: characters in links, and whether it is a heading of the first order
    linked: int
    heading: bool


class Lines(HTMLParser):
    """The lines of a page: text, tags and the element that holds them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.open: list[Element] = []
        #: how often a tag is open, in all and within the section at a place in the stack
        self.count: Counter[tuple[str, int]] = Counter()
        #: open elements that an article may stand in although they stand apart
        self.holding = 0
        self.numbers = 0

    def top(self) -> Element:
        return self.open[-1] if self.open else NONE

    def push(self, e: Element) -> None:
        self.open.append(e)
        self.count[e.tag, -2] += 1
        self.count[e.tag, self.above(e).frame] += 1
        self.holding += e.tag in HOLDING and e.out

    def pop(self) -> Element:
        e = self.open.pop()
        self.count[e.tag, -2] -= 1
        self.count[e.tag, self.top().frame] -= 1
        self.holding -= e.tag in HOLDING and e.out
        return e

    def above(self, e: Element) -> Element:
        return self.open[-2] if len(self.open) > 1 else NONE

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text or self.tags:
            top = self.top()
            heading = top.block >= 0 and self.open[top.block].tag == "h1"
            self.lines.append(Line(text, self.tags, top, self.linked, heading))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in NOT_TEXT:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        block = self.top().block
        if tag in CLOSES_ITSELF and block >= 0 and self.open[block].tag == tag:
            # a new paragraph or item ends the one that is open, and what is open in it
            while len(self.open) > block:
                self.pop()
        if tag in ("article", "main") and self.top().out and not self.holding:
            # an article doesn't begin in a menu or a division for adverts: those were not closed
            while self.open and self.top().out:
                self.pop()
        above, at = self.top(), len(self.open)
        out, likely = standing(tag, dict(attrs), bool(above.article))
        self.numbers += 1
        is_article = tag in ("article", "main")
        self.push(
            Element(
                tag, self.numbers if tag in SECTION else above.section, out or above.out, above.article or (self.numbers if is_article else 0),
                above.likely or (self.numbers if likely else 0), at if tag in BLOCK else above.block, at if tag in SECTION else above.frame,
            )
        )

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.top().tag == tag and tag in ("svg", "math", "iframe", "script"):
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK or tag in NOT_TEXT:
            self.end_line()
        self.tags += 1
        # an inline end tag closes nothing beyond its section
        if self.count[tag, -2 if tag in BLOCK else self.top().frame] > 0:
            while self.pop().tag != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not self.top().out:
            self.text.append(data)
            if self.count["a", -2]:
                self.linked += len("".join(data.split()))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)


def read_lines(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def smoothed(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends count as repeated."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def two_means(x: np.ndarray) -> float:
    """The threshold between two clusters of numbers: half way between their means."""
    threshold = (x.min() + x.max()) / 2
    for _ in range(50):
        low, high = x[x <= threshold], x[x > threshold]
        if not len(low) or not len(high):
            break
        new = (low.mean() + high.mean()) / 2
        if abs(new - threshold) < 1e-9:
            break
        threshold = new
    return float(threshold)


def beside(lines: list[Line]) -> set[int]:
    """The elements whose names say that they stand beside the content, but for those that
    hold most of the text."""
    size: Counter[int] = Counter()
    for x in lines:
        if not x.element.out:
            size[x.element.likely] += len(x.text)
    return {k for k, n in size.items() if k and 2 * n <= sum(size.values())}


def edges(lines: list[Line], keep: np.ndarray) -> np.ndarray:
    """``keep`` without what stands at the ends of a page that has no article element: all before
    the section of the first heading if more follows, divisions of one line, copyright lines."""
    at = np.flatnonzero(keep)
    heads = [i for i in at if lines[i].heading]
    if heads:
        begin = next(i for i in at if lines[i].element.section == lines[heads[0]].element.section)
        before, after = (sum(len(lines[i].text) for i in part) for part in (at[at < begin], at[at >= begin]))
        at = at[at >= begin] if before <= after else at
    size: Counter[int] = Counter(lines[i].element.section for i in at)
    text: Counter[int] = Counter()
    for i in at:
        text[lines[i].element.section] += len(lines[i].text)
    total = sum(text.values())

    def no_content(i: int) -> bool:
        s = lines[i].element.section
        lone = size[s] == 1 and len(size) > 1 and 4 * text[s] <= total and not lines[i].heading and lines[i].element.frame == lines[i].element.block
        return lone or bool(_COPYRIGHT.match(lines[i].text)) and len(at) > 1

    while len(at) > 1 and no_content(at[0]):
        at = at[1:]
    while len(at) > 1 and no_content(at[-1]):
        at = at[:-1]
    out = np.zeros(len(lines), bool)
    out[at] = True
    return out


def main_text(html: str | None) -> str:
    lines = read_lines(html) if html else []
    apart = beside(lines)
    may = np.array([bool(x.text) and not x.element.out and x.element.likely not in apart for x in lines], bool)
    if not may.any():
        return ""
    linked = np.array([x.linked >= LINKED * len("".join(x.text.split())) for x in lines], bool)
    size = np.array([max(len(x.text) - x.linked, 0) if m else 0 for x, m in zip(lines, may, strict=True)], float)
    ratio = smoothed(np.log1p(size / np.maximum([x.tags for x in lines], 1)))
    section, article = np.array([x.element.section for x in lines]), np.array([x.element.article for x in lines])
    content = may & (ratio > two_means(ratio)) & ~linked
    if not content.any():
        content = may & (ratio >= ratio[may].max())
    # an article is whole, its inner divisions included
    whole = may & np.isin(article, np.setdiff1d(article[content], [0]))
    length = np.array([len(x.text) for x in lines])
    if whole.any() and 2 * length[whole].sum() >= length[whole | content].sum():
        keep = whole
    else:
        first = np.flatnonzero(content)[[0, -1]]
        between = np.zeros(len(lines), bool)
        between[first[0] : first[1] + 1] = True
        keep = edges(lines, whole | may & (between | np.isin(section, section[content])) & (~linked | content))
    return " ".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            rows = batch.slice(i, 256)
            texts = [main_text(h) for h in rows.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [rows.column("page_id"), rows.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
