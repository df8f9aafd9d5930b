"""Main text of web pages by tag-path ratios.

A page is parsed into blocks of text, each under its path of block tags from the root.  For each path, the length of
text (text in links counts a tenth) and the punctuation per block are aggregated and fused to a ratio; ratios are
smoothed along the page and averaged by path.  A path is content if its ratio reaches a share of the page's best
ratio.  The share depends on the path's evidence relative to that of the path with the best product of both: element
names and the words of class, id and role names multiply evidence, for (``article``, "content") or against (``nav``,
"sidebar"), and cancel each other.  No name decides alone: long prose under a bad class beats short neutral text, and
names that all paths share have no say.  Only what no browser renders as text (scripts, styles, templates, hidden elements) is skipped.

A page is one row in and one row out, so nothing is shuffled, and time is linear in a page's length and depth.  Edge
cases: a null, empty or text-less page gives ''; markup that is broken (unclosed or stray tags) never fails: blocks
close their paragraph, an end tag closes what it encloses, stray end tags are ignored; repeated rows give equal
results; a null url or page_id passes through.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import strings, table

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
_UNSEEN = frozenset("script style noscript template iframe object svg canvas audio video head title datalist map".split())
_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_SIBLING = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
_KEEPS_P = ("td", "th", "li", "article", "section", "main", "body", "button", "object")  # an open p outside these stays open
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Evidence of element names, and of a class, id or role name for or against content.
ELEMENTS = {"article": 4.0, "main": 4.0} | dict.fromkeys(("nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "option"), 0.05)
FOR, AGAINST, MOST = 2.0, 0.1, 4.0
GOOD = frozenset("article content entry main post story text".split())
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies"
    " copyright disqus dialog disclaimer discussion footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager"
    " pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor"
    " sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
#: A name that only says whether something is there: "has-sidebar", "comments-open".
STATE = frozenset("has with without no is open closed enabled disabled on off count supported".split())
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_MARK = re.compile(r"[^\w\s]")
#: Share of the best path's ratio that a path needs if the evidence of both is neutral.
SHARE = 0.22
LINKED = 0.1


def evidence(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> float:
    """How much an element speaks for (above 1) or against content."""
    weight = ELEMENTS.get(tag, 1.0)
    if tag == "header" and not in_article:
        weight = 0.05
    lean = 0
    for k, v in attrs:
        if k in ("class", "id", "role") and v:
            for name in v.split():
                words = [w.lower() for w in _NAME.findall(name)]
                if any(w in BAD for w in words):
                    lean -= not any(w in STATE for w in words)
                else:
                    lean += any(w in GOOD for w in words)
    return weight * (FOR if lean > 0 else AGAINST if lean < 0 else 1.0)


def _unseen(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in _UNSEEN or any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and _HIDDEN.search(v) for k, v in attrs)


class _Blocks(HTMLParser):
    """Blocks as (path number, text, length of the text in links), in page order, and the paths' evidence."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool, bool]] = []  # tag, path, unseen, in an article, an aside in the line
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.paths: dict[tuple[int, str, float], int] = {}
        self.evidence: list[float] = []
        self.blocks: list[tuple[int, str, int]] = []
        self.text: list[str] = []
        self.linked = 0
        self.outer: list[tuple[list[str], int]] = []  # lines that go on after an aside in them

    def top(self) -> tuple[str, int, bool, bool, bool]:
        return self.stack[-1] if self.stack else ("", -1, False, False, False)

    def flush(self, path: int) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((path, text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def path(self, parent: int, tag: str, weight: float) -> int:
        at = self.paths.setdefault((parent, tag, weight), len(self.paths))
        if at == len(self.evidence):
            self.evidence.append(min(MOST, weight * (self.evidence[parent] if parent >= 0 else 1.0)))
        return at

    def pop(self) -> None:
        tag, path, _, _, aside = self.stack.pop()
        self.depths[tag].pop()
        if aside:
            self.flush(path)
            self.text, self.linked = self.outer.pop()
        elif tag in _BLOCK:
            self.flush(path)

    def last(self, tags: tuple[str, ...]) -> int:
        """Depth of the innermost open element of these, or -1."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=-1)

    def close_open(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        at = self.last(tags)
        if at >= 0 and at > self.last(until):
            while len(self.stack) > at:
                self.pop()

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            if tag == "hr":
                self.flush(self.top()[1])
            elif tag == "br":
                self.handle_data(" ")
            return
        block = tag in _BLOCK
        if block:
            if tag in _ENDS:
                self.close_open(_SIBLING.get(tag, (tag,)), _ENDS[tag])
            else:
                self.close_open(("p",), _KEEPS_P)
            self.flush(self.top()[1])
        _, path, unseen, article, _ = self.top()
        weight, aside = evidence(tag, attrs, article), False
        if block:
            path = self.path(path, tag, weight)
        elif weight < 1.0:  # an advert or the like inside a line: a block of its own, the line goes on after it
            path, aside = self.path(path, tag, weight), True
            self.outer.append((self.text, self.linked))
            self.text, self.linked = [], 0
        self.depths.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, path, unseen or _unseen(tag, attrs), article or tag in ("article", "main"), aside))

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        elif tag in _BLOCK:
            self.flush(self.top()[1])

    def handle_endtag(self, tag):
        at = self.last((tag,))
        while 0 <= at < len(self.stack):
            self.pop()

    def handle_data(self, data):
        if not self.top()[2]:
            self.text.append(data)
            if self.depths.get("a"):
                self.linked += len(data.strip())


def blocks(page: str) -> tuple[list[tuple[int, str, int]], list[float]]:
    """(path, text, linked length) of each block, and the evidence by path."""
    parser = _Blocks()
    parser.feed(page)
    parser.close()
    while parser.stack:
        parser.pop()
    parser.flush(-1)
    return parser.blocks, parser.evidence


def chosen(found: list[tuple[int, str, int]], weights: list[float]) -> np.ndarray:
    """For each block whether its path is content."""
    names, path = np.unique([b[0] for b in found], return_inverse=True)
    count = np.bincount(path).astype(float)
    length = np.bincount(path, [len(t) - (1 - LINKED) * linked for _, t, linked in found]) / count
    marks = np.bincount(path, [len(_MARK.findall(t)) for _, t, _ in found]) / count
    fused = (np.log1p(length) * (1.0 + np.log1p(marks)))[path]
    padded = np.pad(fused, 1, mode="edge")  # smoothing along the page
    smooth = (padded[:-2] + 6.0 * padded[1:-1] + padded[2:]) / 8.0
    ratio = np.bincount(path, smooth) / count
    known = np.array([weights[n] if n >= 0 else 1.0 for n in names])
    best = int((ratio * known).argmax())
    needed = SHARE * np.maximum(1.0, known[best] / known) / np.maximum(1.0, known)
    return (ratio >= needed * ratio[best])[path]


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    found, weights = blocks(page or "")
    if not found:
        return ""
    return "\n".join(t for (_, t, _), keep in zip(found, chosen(found, weights)) if keep)


def _batch(page: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in strings(page)], pa.string())


def extract(html: Column) -> Column:
    return F.arrow_udf(_batch, "string")(html)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", extract(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
