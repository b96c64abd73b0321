"""Main-text extraction from HTML by text-to-tag ratios (operator 3).

The standard library's streaming parser turns a page into *blocks*: runs of text between block-level
tags, each with its text length and the number of tags spent on it.  A block is the "line" of the
text-to-tag-ratio method: on every page ratios are smoothed by a Gaussian, a threshold (a share of
their standard deviation) clusters them into content and boilerplate, and the heaviest cluster is the
content.  What the page says of itself enters as features and as borders:

* text in navigation, headers, footers, asides, forms, scripts and the like, and in elements whose
  class, id or role can only mean such parts (``FURNITURE``: adverts, menus, reader comments, ...), is
  taken out; its blocks keep their place with a ratio of zero;
* names that may as well be a part of an article (``DOUBTFUL``: related, reviews, discussion, ...) say
  nothing by themselves: such an element goes only if its own ratio is under the threshold, or its
  text is short or mostly links;
* blocks inside a declared article (article, main, or an article-like class) have their ratio times
  ``ARTICLE_WEIGHT``; a cluster that lies in articles takes in all their other blocks, so that
  headings and short paragraphs are kept, and ends with them; one outside ends at the nearest
  furniture or links.

Scale: one map over the pages; memory is one page.

Defined results: null, empty and text-free pages give an empty text; broken markup is read as
browsers do (unclosed tags end with their parent); of equally heavy clusters the first is taken; very
long pages are processed whole; repeated rows give one row each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table, with_key

# Element names of the HTML standard by role, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title nav header footer aside form script style noscript template iframe object svg math canvas menu button select textarea dialog audio video map".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar share sharing social cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments disqus paywall toolbar pagination pager".split()
)
DOUBTFUL = frozenset(
    "banner header aside widget related recommended recommendations notice notices respond reply replies discussion reviews feedback alert disclaimer announcement toast tags meta byline copyright legal skip search form teaser".split()
)
#: Parts that turn a furniture name into a statement about layout, as in "has-sidebar".
LAYOUT = frozenset("has with no without not".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar note".split())
ARTICLE_NAMES = frozenset("article content post story entry main maincontent articlebody postcontent entrycontent bodytext".split())
#: Elements whose end tag may be left out: a start tag of the second set closes an open one of the first.
CLOSES = {
    "p": BLOCKS - {"br", "button", "option", "optgroup", "caption", "legend"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
    "head": {"body"},
}
_SCOPES = frozenset("html body table td th ul ol dl div article section main aside nav header footer form blockquote button".split())

SIGMA, SPREAD = 1.0, 0.5
ARTICLE_WEIGHT = 3.0
#: Characters that a doubtful element has at least, and the share of them in links at most, to be content.
DOUBTFUL_CHARS, DOUBTFUL_LINKS = 200, 0.3
_SPACES = re.compile(r"\s+")
_NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


def _names(attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool, str]:
    """(named as furniture, doubtfully, as an article; role) of an element, each class or id name judged by itself."""
    furniture = doubtful = article = False
    role = ""
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.split():
                parts = [p for p in _NAME_PARTS.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", name).lower()) if p]
                parts.append("".join(parts))
                layout = not LAYOUT.isdisjoint(parts)
                furniture |= not layout and not FURNITURE.isdisjoint(parts)
                doubtful |= not layout and not DOUBTFUL.isdisjoint(parts)
                article |= FURNITURE.isdisjoint(parts) and DOUBTFUL.isdisjoint(parts) and not ARTICLE_NAMES.isdisjoint(parts)
        elif key == "role" and value:
            role = value.strip().lower()
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            role = "dialog"
    return furniture, doubtful, article, role


class Block(NamedTuple):
    """A run of text; dropped text only keeps its place.  Numbers of the declared article and of the doubtful element around it, or 0."""

    text: str
    tags: int
    article: int
    doubtful: int
    linked: int


_COMMENT_END = re.compile(r"--(?:!|\s*)>")


class _Blocks(HTMLParser):
    """Collects blocks from parser events."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, bool, int, int]] = []  # (tag, dropped, numbers of the article and the doubtful element it is in)
        self.articles = self.doubts = 0
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.in_links = 0
        self.unseen = False

    def _dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def _flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.text)).strip()
        if text or self.unseen:
            _, _, article, doubtful = self.stack[-1] if self.stack else ("", False, 0, 0)
            self.blocks.append(Block(text, self.tags, article, doubtful, self.linked))
            self.tags = 0
        self.text, self.linked, self.unseen = [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if tag in CLOSES.get(name, ()):
                    del self.stack[k:]
                    break
                if name in _SCOPES:
                    break
        self.tags += 1
        if tag in VOID:
            return
        _, dropped, article, doubt = self.stack[-1] if self.stack else ("", False, 0, 0)
        furniture, doubtful, named, role = _names(attrs) if attrs else (False, False, False, "")
        is_article = tag in ("article", "main") or role in ("main", "article")
        if tag in DROPPED and not (tag == "header" and article) or role in ROLES or (furniture and not named and not is_article and tag not in ("html", "body")):
            dropped = True
        elif is_article or (named and tag in ("div", "section", "td")):
            if not article and not dropped:
                self.articles += 1
                article = self.articles
        elif doubtful and not doubt and tag not in ("html", "body"):
            self.doubts += 1
            doubt = self.doubts
        if tag == "a":
            self.in_links += 1
        self.stack.append((tag, dropped, article, doubt))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.in_links:
            self.in_links -= 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if tag in BLOCKS or any(entry[0] in BLOCKS for entry in self.stack[k:]):
                    self._flush()
                del self.stack[k:]
                return
            if self.stack[k][0] in _SCOPES and tag not in BLOCKS:
                break
        if tag == "br" or tag == "p":
            self._flush()

    def handle_data(self, data):
        if self._dropped():
            self.unseen = True
            return
        self.text.append(data)
        if self.in_links:
            self.linked += len(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """End of the comment at ``i``; the page is fed whole, so an open one runs to its end."""
        close = _COMMENT_END.search(self.rawdata, i + 4)
        return close.end() if close else len(self.rawdata)

    def finish(self) -> list:
        self.close()
        self._flush()
        return self.blocks


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with renormalised borders."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi])) / sum(weights))
    return out


def threshold(smoothed: list[float]) -> float:
    """The smoothed ratio from which a block is content: ``SPREAD`` standard deviations of all."""
    mean = sum(smoothed) / max(1, len(smoothed))
    return SPREAD * math.sqrt(sum((r - mean) ** 2 for r in smoothed) / max(1, len(smoothed)))


def content_region(ratios: list[float]) -> tuple[int, int, list[int]]:
    """([first, last) of the heaviest cluster of high smoothed ratios, all high blocks).

    Clusters that only low runs of up to three blocks part belong together.
    """
    smoothed = smooth(ratios)
    least = threshold(smoothed)
    high = [i for i, r in enumerate(smoothed) if r >= least and r > 0]
    if not high:
        return 0, len(ratios), []
    clusters, start, last = [], high[0], high[0]
    for i in high[1:]:
        if i - last > 4:
            clusters.append((start, last + 1))
            start = i
        last = i
    clusters.append((start, last + 1))
    return *max(clusters, key=lambda c: (sum(ratios[c[0] : c[1]]), -c[0])), high


def _ratio(block: Block) -> float:
    """Unlinked characters a tag, weighted inside declared articles."""
    return max(0, len(block.text) - block.linked) / max(1, block.tags) * (ARTICLE_WEIGHT if block.article else 1.0)


def _without_doubtful(blocks: list[Block]) -> list[Block]:
    """Blocks, those of doubtful elements that don't look like content emptied."""
    groups: dict[int, list[Block]] = {}
    for block in blocks:
        if block.doubtful:
            groups.setdefault(block.doubtful, []).append(block)
    if not groups:
        return blocks
    least = threshold(smooth([_ratio(b) for b in blocks]))
    poor = set()
    for number, own in groups.items():
        size, linked = sum(len(b.text) for b in own), sum(b.linked for b in own)
        ratio = sum(_ratio(b) * len(b.text) for b in own) / max(1, size)
        if size < DOUBTFUL_CHARS or linked > DOUBTFUL_LINKS * size or ratio < least:
            poor.add(number)
    return [Block("", b.tags, b.article, b.doubtful, 0) if b.doubtful in poor else b for b in blocks]


def chosen(blocks: list[Block]) -> list[Block]:
    """The blocks of the content region."""
    blocks = _without_doubtful(blocks)
    if not any(b.text for b in blocks):
        return []
    first, end, high = content_region([_ratio(b) for b in blocks])
    inside = sum(len(b.text) for b in blocks[first:end] if b.article)
    if 2 * inside >= sum(len(b.text) for b in blocks[first:end]) and inside:
        # the cluster lies in articles: all that hold content, whole
        articles = {blocks[i].article for i in high} | {b.article for b in blocks[first:end]}
        return [b for b in blocks if b.article and b.article in articles]
    linked = [b.linked / len(b.text) if b.text else 0.0 for b in blocks]
    while first < end and linked[first] >= 0.5:
        first += 1
    while first < end and linked[end - 1] >= 0.5:
        end -= 1
    if not all(b.text for b in blocks):
        # furniture is declared on this page, so what adjoins the region without links belongs to it
        plain = [bool(b.text) and not b.article and share < 0.3 for b, share in zip(blocks, linked)]
        while first > 0 and plain[first - 1]:
            first -= 1
        while end < len(blocks) and plain[end]:
            end += 1
    return [b for b in blocks[first:end] if not b.article]


def extract(html: str | None) -> str:
    """The main text of one whole page."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    return " ".join(b.text for b in chosen(parser.finish()) if b.text)


def extract_pages(pages: DataFrame, *carry: str) -> DataFrame:
    """The ``carry`` columns, text and n_chars of every page."""

    def kernel():
        def one(*row):
            text = extract(row[-1])
            return [(*row[:-1], text, len(text))]

        return one

    schema = with_key(pages, carry[-1], "text string, n_chars long")
    for name in reversed(carry[:-1]):
        schema.fields.insert(0, pages.schema[name])
        schema.names.insert(0, name)
    return map_rows(pages, [*carry, "html"], kernel, schema)


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"), "page_id", "url")
