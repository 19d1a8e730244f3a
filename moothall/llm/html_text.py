"""HTML extraction (8): the main text of a page from parser events and text-to-tag ratios.

The standard library's parser streams a page once. Its events are gathered into lines, one per
block of text, each with its characters, its link characters and the tags met since the line
before. A line's ratio is its text outside links per tag. The ratios are smoothed with a Gaussian
over neighbouring lines, and lines above a threshold (a share of the smoothed ratios' deviation)
form the content cluster. Content is then taken as whole regions: the region elements (article
or main) that hold a line of the cluster; without such elements, the parents of the cluster's
lines. So a short paragraph between long ones stays.

Menus, headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments
are left out by their element, role, or words of their class or id. A header inside an article
holds the article's title and stays. Words do not count on html, body and main, nor on an article that is
not inside another one: there they speak of the layout. An element left out by a word alone is a wrapper, and what it
holds is judged without it, if it holds the page's main element; or, where no other article has text, if it is outside
articles and the text of its articles is longer than all text outside it (wrappers named after comments or
lists of other articles count only where nothing else is left). A named element that holds all of the text without
any article or main stays left out.

Every page is one row and is parsed in one task, in batches, so memory is that of a batch.

Defined cases: null or empty html gives the empty text; unclosed, unopened and truncated markup
is read as far as it goes; text without any markup is content; repeated pages give repeated rows. Only the
named columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS, SIGMA, THRESHOLD = 2, 1.0, 0.5
MOST_LINKED = 0.5  # of a line's characters, where no region element marks the content

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""
a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rb rp rt ruby s samp small
span strike strong sub sup time tt u var wbr
""".split())
LEFT_OUT = frozenset("""
aside button dialog footer form head iframe menu nav noscript object option script select style svg template textarea title
""".split())
REGIONS = frozenset(("article", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search tablist toolbar".split())
#: Words of class and id that name what is not the article.
NAMES = frozenset("""
ad ads adv advert advertisement advertising adbox banner breadcrumb breadcrumbs comment comments commentlist consent cookie
cookies copyright disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification
outbrain pagination pager popup promo promoted promotion recommendations related replies respond share sharing sidebar
signup skyscraper social sponsor sponsored subscribe taboola teaser toolbar widget
""".split())
#: Those of NAMES whose articles are readers' comments or other pages.
LISTS = frozenset("""
comment comments commentlist disqus outbrain popup promo promoted promotion recommendations related replies respond sponsor
sponsored taboola teaser
""".split())
_WORD = re.compile(r"[a-z]+")
_CLOSES_P = frozenset("""
address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr
main menu nav ol p pre section table ul
""".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}}


class Line:
    __slots__ = ("article", "linked", "parent", "region", "tags", "text", "wrap")

    def __init__(self, text: str, linked: int, tags: int, parent: int, region: int, wrap: int, article: int):
        self.text, self.linked, self.tags, self.parent, self.region = text, linked, tags, parent, region
        self.wrap, self.article = wrap, article


class PageLines(HTMLParser):
    """Lines of text outside the elements that are left out, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.stack: list[tuple[str, bool, int, int, int, int]] = []  # tag, left out, number, region, wrap, article
        self.wraps: dict[int, tuple[int, bool]] = {}  # elements left out by a word: the one around, whether named after a list
        self.of_main: set[int] = set()  # wraps that hold main
        self.of_article: set[int] = set()  # wraps, outside articles, that hold an article
        self.count = self.tags = self.links = self.linked = 0
        self.pieces: list[str] = []

    def _state(self) -> tuple[bool, int, int, int, int]:
        return self.stack[-1][1:] if self.stack else (False, 0, 0, 0, 0)

    def _break(self):
        text = " ".join("".join(self.pieces).split())
        if text:
            _, parent, region, wrap, article = self._state()
            if self.stack and self.stack[-1][0] == "p" or self.stack and self.stack[-1][0][:1] == "h":
                parent = self.stack[-2][2] if len(self.stack) > 1 else 0
            self.lines.append(Line(text, self.linked, self.tags, parent, region, wrap, article))
            self.tags = 0
        self.pieces, self.linked = [], 0

    def _pop(self, at: int):
        self.links -= sum(tag == "a" for tag, *_ in self.stack[at:])
        del self.stack[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        if tag not in INLINE:
            self._break()
        if tag in VOID:
            return
        self._close_implied(tag)
        left_out, _, region, wrap, article = self._state()
        self.count += 1
        named = self._hidden(attrs)
        words = set() if tag in ("html", "body", "main") or tag == "article" and not article else self._words(attrs)
        if words and tag in INLINE:
            named = True
        if tag in REGIONS and not named and left_out and all(t in ("form", "nav", "header") for t, out, *_ in self.stack if out and t in LEFT_OUT) \
                and not any(out and t not in LEFT_OUT and t != "header" for t, out, *_ in self._roots()):
            left_out = False  # an article inside an unclosed menu or a form around the whole page
        if tag in LEFT_OUT or named or (tag == "header" and not region):
            left_out = True
        if tag in REGIONS and not left_out:
            region = region or self.count
            if not article:
                self._hold(wrap, self.of_main if tag == "main" else self.of_article)
        if words and not left_out:
            self.wraps[self.count] = (wrap, not LISTS.isdisjoint(words))
            wrap = self.count
        if tag == "article" and not left_out:
            article = article or self.count
        if tag == "a":
            self.links += 1
        self.stack.append((tag, left_out, self.count, region, wrap, article))

    def _hold(self, wrap: int, found: set[int]):
        while wrap and wrap not in found:
            found.add(wrap)
            wrap = self.wraps[wrap][0]

    def _roots(self):
        """The elements at which leaving out began."""
        before = False
        for entry in self.stack:
            if entry[1] and not before:
                yield entry
            before = entry[1]

    def _close_implied(self, tag: str):
        if tag in _CLOSES_P:
            for at in range(len(self.stack) - 1, -1, -1):
                name = self.stack[at][0]
                if name == "p":
                    self._pop(at)
                    return
                if name not in INLINE:
                    return
        closes = _SIBLINGS.get(tag)
        if closes:
            for at in range(len(self.stack) - 1, -1, -1):
                name = self.stack[at][0]
                if name in closes:
                    self._pop(at)
                    return
                if name not in INLINE and name != "p":
                    return

    @staticmethod
    def _words(attrs) -> set[str]:
        """The words of NAMES in class and id."""
        return {word for key, value in attrs if value and key in ("class", "id") for word in _WORD.findall(value.lower()) if word in NAMES}

    @staticmethod
    def _hidden(attrs) -> bool:
        for key, value in attrs:
            if not value:
                if key == "hidden":
                    return True
                continue
            if key == "role":
                if value.lower() in ROLES:
                    return True
            elif key == "aria-hidden" and value.lower() == "true":
                return True
        return False

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._break()
        for at in range(len(self.stack) - 1, -1, -1):
            name = self.stack[at][0]
            if name == tag:
                self._pop(at)
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline end tag does not close blocks

    def handle_data(self, data):
        if not self._state()[0]:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        return self._outside()

    def _outside(self) -> list[Line]:
        """The lines all of whose wraps hold the content; the tags of the others count for the next line."""
        if not self.wraps:
            return self.lines
        lists: set[int] = set()
        for wrap, (around, of_list) in self.wraps.items():
            if of_list or around in lists:
                lists.add(wrap)
        passed = self._passed(self.of_main)
        seen = [line for line in self.lines if line.wrap in passed]
        if not any(line.article for line in seen):
            more = self._passed(self.of_main | self.of_article - lists)
            length = sum(len(line.text) - line.linked for line in seen)
            if sum(len(line.text) - line.linked for line in self.lines if line.article and line.wrap in more) > length:
                passed = more
            elif not seen:
                passed = self._passed(self.of_main | self.of_article)
        out, tags = [], 0
        for line in self.lines:
            line.tags += tags
            tags = 0 if line.wrap in passed else line.tags
            if line.wrap in passed:
                out.append(line)
        return out

    def _passed(self, wrappers: set[int]) -> set[int]:
        """Those of `wrappers` that lie in no other wrap, and 0 for none."""
        passed = {0}
        for wrap, (around, _) in self.wraps.items():  # outer ones first
            if wrap in wrappers and around in passed:
                passed.add(wrap)
        return passed


def smoothed_ratios(lines: list[Line], radius: int = RADIUS, sigma: float = SIGMA) -> list[float]:
    """Text-to-tag ratios under a Gaussian window over neighbouring lines."""
    ratios = [max(0, len(line.text) - line.linked) / max(1, line.tags) for line in lines]
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for k, w in zip(range(i - radius, i + radius + 1), kernel):
            if 0 <= k < len(ratios):
                total += w * ratios[k]
                weight += w
        out.append(total / weight)
    return out


def main_text(html: str | None, threshold: float = THRESHOLD) -> str:
    """The article's blocks, joined by an empty line."""
    if not html:
        return ""
    parser = PageLines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    smooth = smoothed_ratios(lines)
    mean = sum(smooth) / len(smooth)
    deviation = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    cluster = [s >= threshold * deviation for s in smooth]
    regions = {line.region for line, kept in zip(lines, cluster) if kept and line.region}
    if not regions:
        regions = {line.region for line in lines if line.region}
    if regions:
        chosen = [line.text for line in lines if line.region in regions]
    else:
        parents = {line.parent for line, kept in zip(lines, cluster) if kept and line.linked <= MOST_LINKED * len(line.text)}
        chosen = [line.text for line in lines if line.parent in parents and line.linked <= MOST_LINKED * len(line.text)]
    return "\n\n".join(chosen)


def extract_text(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) per row of `pages`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    read = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in read.schema}
    return read.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op8_html_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


QUERIES = {"op8_html_text": op8_html_text}
ORACLES: dict[str, str] = {}
