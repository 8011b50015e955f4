"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block, in page order; what stands in menus, notices, adverts
and the like leaves an empty line.  Text lengths are summed over sliding windows of lines.  A region
begins where the sum surges over a threshold and ends where it dives to nothing; the lines between
are kept.  A line inside a named article counts with a bonus of one surge, so that it never needs company;
text outside of it is kept where it surges by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold the article's text.
DROPPED = frozenset("head title script style noscript template nav header footer aside form button select textarea option "
                    "iframe object svg canvas audio video dialog menu map".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: Words of a class, id or role that mark menus, adverts, notices, sidebars, forms and reader comments.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
                  "popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar header masthead footer contentinfo complementary "
                  "search comment comments commentlist disqus reply replies respond share sharing social related recommended newsletter subscribe signup login widget skip".split())
KEPT_ANYWAY = frozenset("html body article main".split())


class _Lines(HTMLParser):
    """Collects (text, letters outside links, in_article) for each block; dropped blocks give an empty line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.text, self.plain = [], [], 0
        self.open: list[tuple[str, bool]] = []
        self.dropped = self.links = self.articles = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.plain, self.articles > 0))
        self.text, self.plain = [], 0

    def pop(self) -> None:
        tag, drop = self.open.pop()
        self.dropped -= drop
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in DROPPED:
            self.flush()
        if tag in VOID:
            return
        names = {t for t, _ in self.open[-3:]}
        if tag in ENDS_P and "p" in names:
            self.handle_endtag("p")
        if tag == "li" and self.open and self.open[-1][0] == "li":
            self.pop()
        drop = tag in DROPPED
        if attrs and not drop and tag not in KEPT_ANYWAY:
            named = dict(attrs)
            words = re.split(r"[^a-z]+", " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role")))).lower())
            drop = not MARKS.isdisjoint(words) or "hidden" in named or named.get("aria-hidden") == "true"
        if drop and not self.dropped:
            self.lines.append(("", 0, False))
        self.open.append((tag, drop))
        self.dropped += drop
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK or tag in DROPPED:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if not self.dropped:
            self.text.append(data)
            if not self.links:
                self.plain += len(data) - data.count(" ")


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.lines


def between_surge_and_dive(lengths: list[int], window: int, surge: int) -> list[bool]:
    """Which lines are kept: from each surge of the windowed sum to the dive after it.

    Without any surge, the region with the most text is kept."""
    n = len(lengths)
    sums, run = [0] * n, 0
    for i in range(n - 1, -1, -1):
        run += lengths[i] - (lengths[i + window] if i + window < n else 0)
        sums[i] = run
    regions, i = [], 0
    while i < n:
        if lengths[i] == 0:
            i += 1
            continue
        start, top = i, 0
        while i < n and sums[i]:
            top = max(top, sums[i])
            i += 1
        regions.append((top, start, i))
    kept = [r for r in regions if r[0] >= surge] or sorted(regions, key=lambda r: -r[0])[:1]
    keep = [False] * n
    for _, a, b in kept:
        keep[a:b] = [True] * (b - a)
    return keep


def main_text(html: str | None, window: int = 3, surge: int = 80) -> str:
    lines = lines_of(html or "")
    lengths = [len(t) + surge if inside and t else plain for t, plain, inside in lines]
    keep = between_surge_and_dive(lengths, window, surge)
    return " ".join(t for (t, _, _), k in zip(lines, keep, strict=True) if k and t)


def extract(pages: DataFrame, window: int = 3, surge: int = 80, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null or empty html, and pages without text, give an empty text.  Ids and addresses are passed on
    as they are, null and repeated ones included; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                text = [main_text(x.as_py(), window, surge) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                                                 names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint").withColumnsRenamed({"page_id": page_id, "url": url})
