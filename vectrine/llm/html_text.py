"""Main text of web pages by text-to-tag ratio.

The standard library's parser streams its events. Block-level tags end a line; a line has its text, of which
that in links does not count, and the number of tags it took. Elements that usually stand beside an article (menus,
forms, and boxes whose class, id or role says so) lower the ratio of their lines to a 64th, each time one lies in
another. The logarithms of the ratios are smoothed by a Gaussian along the page, over
lines with as many marks. Clustering parts content from the rest: one cluster has its centre at the origin, where
lines without text lie, the other's is the mean of its lines. A region (article, main, section, division, cell,
body, marked element or list of links) that holds a line on the far side is content and gives all its lines, so
that headings and short paragraphs between long ones stay; unless none of its lines comes half as far before
smoothing, which then only has the level of what stands next to it.

Nulls: a null html is an empty page and gives an empty text. Unclosed and stray tags are tolerated. Scripts, styles
and the like are not text, nor is an unclosed comment. Very long pages take time and memory in proportion: a scanner
finds where each tag ends, quoted values respected, and hands the parser whole tags. No size decides whether something is
a tag or text; only what has no > after it is text. Repeated rows give equal texts, no rows none; columns of other names,
also those of the result, don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements by kind, from the HTML standard.
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
))
HEAD = frozenset((
    "base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title",
))
HIDDEN = frozenset((
    "head", "script", "style", "noscript", "template", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select", "textarea",
    "button", "datalist",
))
APART = frozenset((
    "nav", "header", "footer", "aside", "form", "menu", "dialog",
))
REGIONS = frozenset((
    "article", "main", "section", "div", "body", "td",
))
# Words in class, id and role that name a part beside the article.
BESIDE = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adsense", "banner", "sponsor", "sponsored", "promo",
    "promotion", "promoted", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "header", "masthead", "topbar", "footer",
    "bottom", "sidebar", "aside", "complementary", "contentinfo", "search", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "comment", "comments", "commentlist", "reply",
    "replies", "respond", "disqus", "discussion", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager",
    "toolbar", "widget", "skip", "hidden",
))
#: Elements beside scripts and styles that hold no others.
RAW = frozenset(("textarea", "title", "iframe"))
LISTS = frozenset(("ul", "ol", "dl", "menu"))
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Attribute values of this length say nothing to us; embedded images have them. Only tags are looked at.
_LONG_VALUE = re.compile(r"""=\s*(?:"[^"]{1000,}"|'[^']{1000,}')""")
_END = re.compile(r"</[^\s/>]+")
_PLAIN = re.compile(r"""[^"'>]*""")
#: A ratio of so many characters a tag is little.
LITTLE = 8.0
MARK = 1 / 64
#: A marked line with fewer characters a tag makes nothing content: a page may hold menus alone.
MUCH = 80.0


def _beside(attrs) -> bool:
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for one in value.split():
                words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower())
                # a box that says it has, or lacks, a sidebar is not one
                if not BESIDE.isdisjoint(words) and words[0] not in ("no", "with", "without", "has", "hide"):
                    return True
    return False


def _unseen(attrs) -> bool:
    return any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs)


class Lines(HTMLParser):
    """Collects (text, characters outside links, tags, marks, region) of each line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.outside = self.regions = 0
        # tag, whether it is seen, marks, region, list
        self.open: list[tuple[str, bool, int, int, int]] = [("", True, 0, 0, 0)]
        self.inside: Counter[str] = Counter()

    def read(self, html: str) -> None:
        """Hand the page on tag by tag, so that the parser never waits for the end of one; each character is looked at a few times at most."""
        at, self.loose, self.last, self.endless = 0, False, html.rfind(">"), set()
        while (begin := html.find("<", at)) >= 0:
            mark = html[begin + 1 : begin + 2]
            if mark.isascii() and mark.isalpha() or mark == "/" and html[begin + 2 : begin + 3].isalpha():
                end = self._tag_end(html, begin)
            elif html.startswith("<!--", begin):
                end = html.find("-->", begin + 2) + 3
                if end < 3:  # an unclosed comment hides what follows
                    break
            elif mark and mark in "!?/":
                end = html.find("]]>", begin) + 3 if html.startswith("<![CDATA[", begin) else html.find(">", begin) + 1
            else:
                end = 0
            if end <= begin:
                self._text(html[at : begin + 1])
                at = begin + 1
                continue
            self._text(html[at:begin])
            at = end
            if mark in "!?" or mark == "/" and not html[begin + 2].isalpha():
                continue
            tag = html[begin:end] if mark != "/" else f"{_END.match(html, begin)[0]}>"
            self.feed(_LONG_VALUE.sub('=""', tag) if len(tag) > 1000 else tag)
            if self.rawdata:  # the parser takes it for something else
                self.rawdata = ""
            raw = self.cdata_elem or (self.open[-1][0] if mark != "/" and self.open[-1][0] in RAW else None)
            if raw is not None:
                found = re.compile(rf"</{raw}(?=[\s/>])", re.I).search(html, at) if raw not in self.endless else None
                if found:
                    at = found.start()
                elif self.cdata_elem is not None:  # an unclosed script hides what follows
                    break
                else:
                    self.endless.add(raw)
                self.clear_cdata_mode()
        else:
            self._text(html[at:])
        self.flush()

    def _text(self, raw: str) -> None:
        if raw:
            self.handle_data(unescape(raw) if "&" in raw else raw)

    def _tag_end(self, html: str, begin: int) -> int:
        """Where the tag that begins here ends, 0 if it does not. Quoted values are respected, up to the first tag that has no end then."""
        at = begin
        while not self.loose:
            at = _PLAIN.match(html, at).end()
            if at >= len(html):
                self.loose = True
            elif html[at] == ">":
                return at + 1
            else:
                before = at - 1
                while html[before].isspace():
                    before -= 1
                close = html.find(html[at], at + 1) if html[before] == "=" else at
                self.loose = close < 0
                at = close + 1
        if begin >= self.last:
            return 0
        return html.find(">", begin) + 1

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            _, _, marks, region, listed = self.open[-1]
            # a list's lines that are links alone are apart from what else its region holds
            self.lines.append((text, self.outside, self.tags, marks, -listed if listed and not self.outside else region))
            self.tags = 0
        self.parts.clear()
        self.outside = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            top = self.open[-1][0]
            if top in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and (tag == top or top == "p"):
                self._close(top)
            elif self.inside["p"] and tag not in ("li", "dd", "dt"):
                self._close("p")
        # the head's end tag may be left out: the body, or what cannot stand in a head, ends it
        if tag == "body" or tag not in HEAD and self.open[-1][0] == "head":
            self._close("head")
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        _, seen, marks, region, listed = self.open[-1]
        if seen and (tag in HIDDEN or tag not in ("html", "body") and _unseen(attrs)):
            self.flush()
            seen = False
        marked = tag in APART or tag not in ("html", "body") and _beside(attrs)
        if marked or tag in REGIONS or tag in LISTS:
            self.flush()
            self.regions += 1
            if tag in LISTS:
                listed = self.regions
            if marked or tag in REGIONS:
                region, listed = self.regions, 0 if tag in REGIONS else listed
            marks = min(3, marks + marked)
        self.open.append((tag, seen, marks, region, listed))
        self.inside[tag] += 1

    def _close(self, tag) -> None:
        if self.inside[tag]:
            while True:
                last = self.open.pop()[0]
                self.inside[last] -= 1
                if last == tag:
                    return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS or tag in HIDDEN:
            self.flush()
        elif self.inside[tag] and self.open[-1][0] == tag and len(self.open) > 1 and self.open[-1][3] != self.open[-2][3]:
            self.flush()  # a marked element that is no block
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if self.open[-1][0] == "head" and not data.isspace():
            self._close("head")
        if self.open[-1][1]:
            self.parts.append(data)
            if not self.inside["a"]:
                self.outside += len(data) if data.isalnum() else len(_SPACE.sub("", data))


def smooth(values, sigma: float, groups=None) -> np.ndarray:
    """Gaussian smoothing over values of the same group; weights of others and beyond the ends are left out and the rest made to sum to one."""
    values = np.asarray(values, float)
    groups = np.zeros(len(values)) if groups is None else np.asarray(groups)
    total, weight = values.copy(), np.ones(len(values))
    for d in range(1, min(len(values) - 1, max(1, math.ceil(3 * sigma))) + 1):
        w = math.exp(-(d * d) / (2 * sigma * sigma)) * (groups[d:] == groups[:-d])
        total[d:] += w * values[:-d]
        weight[d:] += w
        total[:-d] += w * values[d:]
        weight[:-d] += w
    return total / weight


def threshold(values: np.ndarray) -> float:
    """Half the mean of the values that lie nearer to it than to the origin, from the greatest value on."""
    high = float(values.max())
    while True:
        mean = float(values[values >= high / 2].mean())
        if not mean < high - 1e-12:
            return high / 2
        high = mean


def blocks(html: str, sigma: float = 1.0) -> list[str]:
    """Blocks of the article in page order."""
    parser = Lines()
    parser.read(html)
    lines = parser.lines
    if not lines:
        return []
    outside, tags, marks = np.array([line[1:4] for line in lines], float).T
    ratio = outside / np.maximum(tags, 1)
    own = np.log1p(ratio * MARK**marks / LITTLE)
    level = smooth(own, sigma, marks)
    least = threshold(level)
    far = (level >= least) & (level > 0) & ((marks == 0) | (ratio >= MUCH))
    regions = [line[4] for line in lines]
    content = {r for r, v in zip(regions, far, strict=True) if v} & {r for r, v in zip(regions, own, strict=True) if v >= least / 2}
    return [line[0] for line in lines if line[4] in content]


def main_text(html: Column) -> Column:
    """The article of each page, its blocks joined by an empty line."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series(["\n\n".join(blocks(p)) for p in pages], dtype=object)

    return text(F.coalesce(html, F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
