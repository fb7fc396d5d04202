"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is a block of the page: the text between two block-level tags, with inline tags counted. The clusters choose the region of the
page that is read; inside it every line outside page furniture stays, however short. Null and empty pages have an empty text. Nothing
is cut: a block of any length is one line. Open tags are found by name, so deep and unclosed markup takes linear time. Repeated rows give
repeated results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.batches import struct_column

# Tags that end a line of text, tags whose text is never read, tags and names of page furniture.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 "
    "h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea button head title noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NAMES = re.compile(
    r"(?:^|[-_])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|widget|header|footer|"
    r"masthead|cookies?|consent|notice|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|comments?|replies|reply|"
    r"respond|disqus|pagination|pager|copyright|legal|toolbar|skip|login|signup)(?:$|[-_]|\d)",
    re.IGNORECASE,
)
# Of an article or main element only these names make furniture: other words describe what it holds.
FOREIGN = re.compile(r"(?:^|[-_])(?:advert\w*|sponsor\w*|related|recommend\w*|comments?|replies|reply)(?:$|[-_]|\d)", re.IGNORECASE)
# Compound names that are none: the head of an article, and states of a page such as "has-sidebar".
OWN_HEAD = re.compile(r"(?:article|post|entry|story)[-_]+header|(?:has|no|with|without|is)[-_].*", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
CONTAINERS = frozenset("html body main article section div table tbody tr td center".split())
IMPLIED_STOPS = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
PARTS = frozenset("p li dt dd option tr td th".split())
WHITE = re.compile(r"\s+")


def furniture_name(names: str, pattern: re.Pattern = NAMES) -> bool:
    """Whether a class or id names page furniture. A furniture word wins over the other words of a compound name."""
    return any(pattern.search(name) and not OWN_HEAD.fullmatch(name) for name in names.split())


@dataclass(frozen=True)
class Line:
    """A block's text, the tags inside, its characters inside links, its article (0: none), container, and whether it is furniture."""

    text: str
    tags: int
    linked: int
    furniture: bool
    article: int
    container: int


@dataclass(frozen=True)
class Open:
    tag: str
    silent: bool = False
    furniture: bool = False
    article: int = 0
    container: int = 0
    link: bool = False


ROOT = Open("")


class Lines(HTMLParser):
    """Collects lines while a page streams through; `parents` holds the parent of each container, container 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [0]
        self.open: list[Open] = []
        self.places: dict[str, list[int]] = {}  # places of the open tags of a name
        self.barriers: list[int] = []  # places of open block-level and silent tags
        self.text: list[str] = []
        self.tags = self.articles = self.linked = 0

    def state(self) -> Open:
        return self.open[-1] if self.open else ROOT

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.text)).strip()
        if text:
            at = self.state()
            self.lines.append(Line(text, self.tags, self.linked, at.furniture, at.article, at.container))
            self.tags = 0
        self.text, self.linked = [], 0

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close_from(self, place: int) -> None:
        for i in range(len(self.open) - 1, place - 1, -1):
            self.places[self.open[i].tag].pop()
            if self.barriers and self.barriers[-1] == i:
                self.barriers.pop()
        del self.open[place:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        if tag in PARTS:  # a new one ends an open one
            self.close_implied(tag)
        at = self.state()
        named = {k: v or "" for k, v in attrs}
        names = f"{named.get('class', '')} {named.get('id', '')}"
        role = named.get("role", "")
        main, article = tag in ("article", "main") or role in ("main", "article"), at.article
        if main and not article:
            self.articles += 1
            article = self.articles
        # Inside an article, header is the article's own head.
        furniture = at.furniture or (tag in FURNITURE and not (tag == "header" and article)) or role in ROLES
        if tag not in ("body", "html", "p"):
            furniture = furniture or furniture_name(names, FOREIGN if main else NAMES)
        furniture = furniture or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        container = at.container
        if tag in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS or tag in SILENT:
            self.barriers.append(len(self.open))
        self.open.append(Open(tag, at.silent or tag in SILENT, furniture, article, container, at.link or tag == "a"))

    def close_implied(self, tag: str) -> None:
        """End an open tag of the name unless another list, table or block has been opened inside it."""
        place, stops = self.last(tag), IMPLIED_STOPS.get(tag)
        if place < 0:
            return
        if stops:
            blocked = any(self.last(name) > place for name in (*stops, *SILENT))
        else:
            blocked = bool(self.barriers) and self.barriers[-1] > place
        if not blocked:
            self.close_from(place)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        place = self.last(tag)
        if place >= 0:
            self.close_from(place)

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1

    def handle_data(self, data):
        at = self.state()
        if not at.silent:
            self.text.append(data)
            if at.link:
                self.linked += len(data.strip())


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the kernel is normalised at the edges."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel, mode="full")[reach : reach + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def content_lines(lines: list[Line], parents: list[int], sigma: float = 1.0) -> list[int]:
    """Numbers of the lines that belong to the main text.

    Lines outside furniture are scored by characters per tag, smoothed, and cut at the standard deviation of the page. Runs above the
    threshold are the clusters. A page with articles (or a main part) keeps all lines of those that hold a cluster's line. On
    any other page the region is the smallest container that holds every cluster and at least half of the text. All lines of
    the region stay, but before the first and behind the last cluster those that are mostly links, which are menus without a name, go.
    """
    free = [i for i, line in enumerate(lines) if not line.furniture]
    if not free:
        return []
    sizes = np.array([len(lines[i].text) for i in free], np.float64)
    ratios = smooth(sizes / np.array([max(1, lines[i].tags) for i in free]), sigma)
    dense = ratios >= min(ratios.std(), ratios.max())
    hit = {lines[i].article for i, ok in zip(free, dense, strict=True) if ok} - {0}
    if any(lines[i].article for i in free):
        articles = sorted({lines[i].article for i in free} - {0})
        held = [sum(len(lines[i].text) for i in free if lines[i].article == a) for a in articles] if not hit else []
        hit = hit or {articles[int(np.argmax(held))]}
        return [i for i in free if lines[i].article in hit]
    inside = region([lines[i].container for i in free], parents, dense, sizes)
    first, last = np.nonzero(dense)[0][[0, -1]]
    return [
        i for at, i in enumerate(free)
        if inside[lines[i].container] and (first <= at <= last or 2 * lines[i].linked <= len(lines[i].text))
    ]


def region(containers: list[int], parents: list[int], dense: np.ndarray, sizes: np.ndarray) -> list[bool]:
    """For each container whether it lies in the smallest one that holds all dense lines and half of the text.

    Containers are numbered as they open, so a parent comes before its children and sums need one pass.
    """
    clustered, held = np.zeros(len(parents), np.int64), np.zeros(len(parents))
    np.add.at(clustered, containers, dense.astype(np.int64))
    np.add.at(held, containers, sizes)
    for k in range(len(parents) - 1, 0, -1):
        clustered[parents[k]] += clustered[k]
        held[parents[k]] += held[k]
    chosen = int(np.nonzero((clustered == clustered[0]) & (2 * held >= held[0]))[0][-1])
    inside = [False] * len(parents)
    for k in range(len(parents)):
        inside[k] = k == chosen or (k > 0 and inside[parents[k]])
    return inside


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return "\n".join(parser.lines[i].text for i in content_lines(parser.lines, parser.parents))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points)."""
    read = struct_column(lambda: lambda texts: [(x, len(x)) for x in map(main_text, texts)], "text string, n_chars long")
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), read(F.col(html_col)).alias("t")).select(
        "page_id", "url", "t.text", "t.n_chars"
    )
