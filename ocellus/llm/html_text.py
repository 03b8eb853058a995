"""Main text of web pages.

Events of the standard library's parser cut a page into lines, one for each
block.  Each line's text-to-tag ratio is smoothed by a Gaussian over its
neighbours, and a two-means threshold divides the lines into content and the
rest.  The content lines select the region: the article or main elements if
they hold most of their text, or else the deepest container that holds nearly
all of it, along with any article elsewhere and the headings, paragraphs and
other text beside it.  All blocks of the region are returned, so that short
paragraphs stay, except those in elements that never are content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.llm._arrow import map_batches

EXTRACTED = "page_id long, url string, text string, n_chars long"

#: Elements without an end tag, elements that break a line, elements that never are content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
NEVER = frozenset("aside button canvas datalist dialog footer form head iframe input menu nav noembed noframes noscript object script search select style svg template textarea title".split())
#: Words in class or id, and roles, of elements that never are content.
NEVER_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus disclaimer footer "
    "gdpr login menu modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion recommended related "
    "reply replies share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
NEVER_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status".split())
#: Headers of the page are no content; those of an article hold its title.
HEADER = frozenset("header masthead".split())
#: Elements that an opening tag closes, if they are the innermost block.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "p": {"p"}}
ROOTS = frozenset(("html", "body", "article", "main"))
#: Elements for text, which are no region of their own; their text beside the region is content unless it is a link's.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTUAL = HEADINGS | frozenset("address blockquote caption dd dl dt figcaption figure hgroup li ol p pre summary table tbody tfoot thead tr ul".split())
#: Fixed value: so many characters, not of links, are content in any element beside the region.
SENTENCE = 25
#: Elements of the head; any other element's opening tag ends a head without an end tag.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Words after which a name says what a page has, not what an element is.
QUALIFIERS = frozenset("has no not with without".split())
#: Words that also name layouts, so that an element named by these alone can hold a page's own text.
LAYOUT = frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation sidebar toolbar topbar widget".split())
#: Words of an element's own text; a name that holds one of them, and otherwise only words of layouts or of these extras, may be a wrapper's.
CONTENT_NAMED = frozenset("article body content entry main page post story text".split())
EXTRAS = frozenset("ad ads popup promo related share sharing social subscribe subscription".split())
#: How sure it is that an element is no content: unless it holds the page's article; unless it holds that or most of the text; always.
NAMED, LAID_OUT, ALWAYS = 1, 2, 3
_NAME = re.compile(r"[a-z]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Lines(HTMLParser):
    """Collects a page's lines: text, tags, the path of elements, and whether they can be content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents: list[int] = [-1]
        self.names: list[str] = ["#page"]
        self.excluded: list[int] = [0]  # of each element: 0, NAMED, LAID_OUT or ALWAYS
        self.named: list[bool] = [False]  # of each element: whether its own names are of elements that never are content
        self.stack: list[tuple[str, int]] = [("#page", 0)]  # name, number
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.within: list[int] = []
        self.linked: list[int] = []
        self.open: list[str] = []
        self.count = self.link = 0
        self.articles = 0  # open article and main elements
        self.in_link = False

    @property
    def in_article(self) -> bool:
        return self.articles > 0

    def _cut(self, depth: int) -> None:
        """Closes the open elements from ``depth`` on."""
        self.articles -= sum(name in ("article", "main") for name, _ in self.stack[depth:])
        del self.stack[depth:]

    def flush(self) -> None:
        text = " ".join("".join(self.open).split())
        if text:
            self.texts.append(text)
            self.tags.append(self.count)
            self.within.append(self.stack[-1][1])
            self.linked.append(self.link)
        self.open, self.count, self.link = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in IN_HEAD and self.stack[-1][0] == "head" or tag == "body":
            self._end_head()
        block = tag in BLOCK
        named = self._excluded(attrs) if attrs else 0
        excluded = 0 if tag in ROOTS else named
        if tag == "form":
            excluded = max(excluded, NAMED)
        elif tag in NEVER or tag == "header" and not self.in_article:
            excluded = ALWAYS
        if block:
            self.flush()
            while self.stack[-1][0] in (closes := CLOSED_BY.get(tag, {"p"})) or (self.stack[-1][0] == "p" and "p" in closes):
                self.stack.pop()
        self.count += 1
        if tag == "a":
            self.in_link = True
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                self.open.append(" " if tag != "wbr" else "")
            return
        if block or excluded:
            if excluded and not block:
                self.flush()
            self.names.append(tag)
            self.parents.append(self.stack[-1][1])
            self.excluded.append(excluded)
            self.named.append(named > 0)
            self.stack.append((tag, len(self.names) - 1))
            self.articles += tag in ("article", "main")
        elif tag in ("td", "th"):
            self.open.append(" ")

    def _end_head(self) -> None:
        """Closes the head, and what is left open in it."""
        for depth, (name, _) in enumerate(self.stack):
            if name == "head":
                self.flush()
                self._cut(depth)
                return

    def _excluded(self, attrs: list[tuple[str, str | None]]) -> int:
        found: set[str] = set()
        header, laid_out = False, True
        for name, value in attrs:
            if name in ("class", "id"):
                for part in (value or "").split():
                    words = _NAME.findall(_CAMEL.sub(" ", part).lower())
                    if words[-1:] == ["free"]:
                        continue  # ad-free: the name of what is not there
                    words = set(takewhile(lambda w: w not in QUALIFIERS, words))
                    own = words & NEVER_NAMED
                    header |= bool(words & HEADER)
                    laid_out &= own <= (LAYOUT | EXTRAS if words & CONTENT_NAMED else LAYOUT)
                    found |= own
            elif name == "role" and (value or "").lower() in NEVER_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
                return ALWAYS
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or "", re.I):
                return ALWAYS
        if header and not self.in_article:
            return LAID_OUT if laid_out else NAMED
        return 0 if not found else LAID_OUT if laid_out else NAMED

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth][0] == tag:
                self.flush()
                self._cut(depth)
                return
            if self.stack[depth][0] in ("article", "main", "body") and tag not in ROOTS:
                break
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and not data.isspace():
            self._end_head()
        self.open.append(data)
        if self.in_link:
            self.link += len("".join(data.split()))


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the window is cut off and weighed anew."""
    if not len(values):
        return values
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total, weight = np.zeros(len(values)), np.zeros(len(values))
    for shift, k in zip(range(-reach, reach + 1), kernel, strict=True):
        a, b = max(0, -shift), min(len(values), len(values) - shift)
        if a < b:
            total[a:b] += k * values[a + shift : b + shift]
            weight[a:b] += k
    return total / weight


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Lines above the threshold between the two means of the smoothed ratios' logarithms."""
    x = np.log1p(smoothed(ratios))
    low, high = (x.min(), x.max()) if len(x) else (0.0, 0.0)
    if high - low < 1e-9:
        return np.ones(len(x), bool)
    for _ in range(30):
        near_high = x - low > high - x
        new = (x[~near_high].mean() if (~near_high).any() else low, x[near_high].mean() if near_high.any() else high)
        if new == (low, high):
            break
        low, high = new
    return x - low > high - x


def never_content(page: Lines) -> np.ndarray:
    """Whether each element is, or is in, one that never is content.

    Names and forms do not exclude the element around the page's article, when
    no article is outside, nor do names of layouts the element around most of the text.
    """
    excluded, parents = page.excluded, page.parents
    never = np.array(excluded) > 0
    for i in range(1, len(never)):
        never[i] |= never[parents[i]]
    unsure = [i for i, e in enumerate(excluded) if 0 < e < ALWAYS]
    if not unsure:
        return never
    # Characters that are not a link's, and articles, in each element except in those that always are excluded.
    own, articles = np.zeros(len(never)), np.zeros(len(never), np.int64)
    np.add.at(own, np.array(page.within, np.int64), np.maximum(0, np.array([len(t) for t in page.texts]) - np.array(page.linked)))
    allowed = own.copy()
    for i, name in enumerate(page.names):
        articles[i] = name in ("article", "main") and not page.named[i]
    all_articles = articles.copy()
    for i in range(len(never) - 1, 0, -1):
        if excluded[i] != ALWAYS:
            own[parents[i]] += own[i]
            articles[parents[i]] += articles[i]
    # Text and articles in each element that no excluded element inside it holds.
    free, free_articles = allowed.copy(), all_articles.copy()
    for i in range(len(never) - 1, 0, -1):
        if not excluded[i]:
            free[parents[i]] += free[i]
            free_articles[parents[i]] += free_articles[i]
    text, outside = free[0], free_articles[0]
    never = np.zeros(len(excluded), bool)
    for i in range(1, len(never)):
        never[i] = never[parents[i]] or excluded[i] > 0
        if not never[i] or never[parents[i]] or excluded[i] == ALWAYS:
            continue
        if not outside and own[i] > text and (articles[i] or excluded[i] == LAID_OUT):
            never[i] = False
            text, outside = text + free[i], outside + free_articles[i]
    return never


def main_text(html: str | None) -> str:
    """A page's main text; empty for a null or empty page or one without content."""
    page = Lines()
    page.feed(html or "")
    page.close()
    page.flush()
    if not page.texts:
        return ""
    never = never_content(page)[np.array(page.within)]
    if never.all():
        return ""
    size = np.array([len(t) for t in page.texts], np.float64)
    ratios = np.where(never, 0.0, size / np.maximum(1, np.array(page.tags)))
    chosen = content_lines(ratios) & ~never
    if not chosen.any():
        chosen = ~never
    # What each element holds: characters of chosen lines; children come after their parents.
    held = np.zeros(len(page.names))
    np.add.at(held, np.array(page.within), np.where(chosen, size, 0))
    for i in range(len(held) - 1, 0, -1):
        held[page.parents[i]] += held[i]
    total = held[0]
    inside = np.zeros(len(held), bool)
    # Elements with text that can be content; an article is kept even if none of its lines is chosen.
    allowed, parted = np.zeros(len(held), bool), np.zeros(len(held), bool)
    allowed[np.array(page.within)[~never]] = True
    for i in range(len(held) - 1, 0, -1):
        allowed[page.parents[i]] |= allowed[i]
        parted[page.parents[i]] |= allowed[i]
    articles = [i for i, name in enumerate(page.names) if name in ("article", "main") and allowed[i]]
    outer: set[int] = set()
    for i in articles:
        up = page.parents[i]
        while up > 0 and up not in outer:
            up = page.parents[up]
        if up <= 0:
            outer.add(i)
    inside[list(outer)] = True
    alone = bool(outer) and sum(held[i] for i in outer) >= 0.5 * total
    if not alone:
        inside[max((i for i in range(len(held)) if parted[i] and page.names[i] not in TEXTUAL and held[i] >= 0.9 * total), default=0)] = True
    for i in range(1, len(held)):
        inside[i] |= inside[page.parents[i]]

    def beside(i: int) -> bool:
        """Whether a line outside the region is content."""
        name = page.names[page.within[i]]
        if name in HEADINGS:
            return True
        return 2 * page.linked[i] <= len(page.texts[i]) - page.texts[i].count(" ") and (name in TEXTUAL or len(page.texts[i]) >= SENTENCE)

    return "\n".join(t for i, t in enumerate(page.texts) if not never[i] and (inside[page.within[i]] or not alone and beside(i)))


def extract(pages: DataFrame) -> DataFrame:
    """Each page's main text and its length in code points.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one newline in page order.  Null or empty
    pages have an empty text; each row gives one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                texts = [main_text(v.as_py()) for v in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, EXTRACTED)
