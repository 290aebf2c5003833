"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser sends events; they become lines (one a block of text), each with its text-to-tag
ratio.  The ratios are smoothed with a Gaussian kernel and parted in two clusters; lines of the upper cluster are the
content regions.  Regions decide what the article is: the ``article`` elements that hold regions, if they hold most of
them together, else the innermost container that does.  Its lines are the result, in page order, without those inside
elements that are no article by their tag, role, class or id, and without lists of links of which none is a region by
itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body button canvas center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main math menu nav noscript object ol optgroup option p pre section select summary svg table tbody td template textarea tfoot th thead title tr ul video audio".split()
)
SILENT = frozenset("aside audio button canvas dialog footer form head header iframe math menu nav noscript object select svg template textarea title video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base head html link meta noscript script style template title".split())
SILENT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Open elements that a start tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
#: Elements that an end tag from inside does not end.
FENCES = frozenset("article body main td th".split())
#: Words of classes and ids that say no article, and words that say nothing beside them.  A name counts if each of its words is
#: one of these and one at least of the first kind: "comments-list" does, "related-work" does not.
SILENT_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion disclaimer footer header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
PLAIN_NAMES = frozenset("area articles bar block bottom box buttons center col column container content first fixed form global group inner item items last left links list main mobile outer page panel posts primary right row secondary section site slot sticky text thread to top unit wrap wrapper".split())
#: Kernel of the smoothing, in lines.
SIGMA = 1.0
#: Logarithm of the ratios' quotient from which two clusters are two.
APART = float(np.log(3.0))
#: Share of the content regions' text that the article must hold.
MAJORITY = 0.8
#: Text of an article element, against the longest one, from which it needs no region of its own.
PEER = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Lines that make a list of links, and the share of their characters inside links.
LINK_LINES, LINKED = 3, 0.9

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def says_no_article(value: str) -> bool:
    """Whether one of the names in a class or id attribute does."""
    for name in value.split():
        words = {w.lower() for w in _NAME.findall(name)}
        if words & SILENT_NAMES and words <= SILENT_NAMES | PLAIN_NAMES:
            return True
    return False


class LineParser(HTMLParser):
    """Collects lines: (text, tags, characters in links, element).

    Elements are numbered as they open, a parent before its children: ``parent``, ``tag_of``, ``never`` (no article
    whatever the page) and ``named`` (no article by its form, role, class or id).  End tags that may be left out are put in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parent, self.tag_of, self.never, self.named = [-1], [""], [False], [False]
        self.open: list[int] = [0]
        self.raw: list[str] = []
        self.tags = self.linked = self.links = 0

    def end_line(self) -> None:
        if self.raw and (text := " ".join("".join(self.raw).split())):
            self.lines.append((text, self.tags, self.linked, self.open[-1]))
            self.tags = 0
        self.raw.clear()
        self.linked = 0

    def close_to(self, k: int) -> None:
        self.end_line()
        del self.open[k:]

    def end_others(self, tag: str) -> None:
        """End elements that the start of ``tag`` ends."""
        ended, fences = ENDS.get(tag, (frozenset(), frozenset()))
        for k in range(len(self.open) - 1, 0, -1):
            other = self.tag_of[self.open[k]]
            if other in ended or other == "head" and tag not in IN_HEAD or other == "p" and tag in BLOCKS:
                self.close_to(k)
                if other != "p":
                    return
            elif other in fences or other in FENCES or (other in BLOCKS and tag not in ENDS):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.end_line()
            self.end_others(tag)
        elif tag == "br":
            self.raw.append(" ")
        self.tags += 1
        if tag == "a":
            self.links = 1
        if tag in VOID:
            return
        never, named = self.judged(tag, attrs)
        if tag in BLOCKS or never or named:
            if tag not in BLOCKS:  # a plain element that is marked as no article stands apart, as a block
                self.end_line()
            self.parent.append(self.open[-1])
            self.tag_of.append(tag)
            self.never.append(never)
            self.named.append(named)
            self.open.append(len(self.parent) - 1)

    @staticmethod
    def judged(tag: str, attrs: list) -> tuple[bool, bool]:
        never, named = tag in SILENT and tag != "form", tag == "form"
        if tag in ("body", "html", "article", "main", "a"):
            return never, named
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                never = True
            elif name == "role" and value in SILENT_ROLES or name in ("class", "id") and value and says_no_article(value):
                named = True
        return never, named

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.links = 0
        if tag in ("body", "html"):
            return  # what stands behind belongs to the body
        for k in range(len(self.open) - 1, 0, -1):
            other = self.tag_of[self.open[k]]
            if other == tag:
                self.close_to(k)
                return
            if other in FENCES or tag not in BLOCKS and other in BLOCKS:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe", "object", "canvas"):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in ("script", "style"):
            return
        self.raw.append(data)
        if self.links:
            self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the edges lean on what there is."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[cut] / np.convolve(np.ones(len(values)), kernel)[cut]


def two_clusters(values: np.ndarray) -> float:
    """The threshold halfway between the means of the two clusters that it parts; the least value if the means lie less
    than ``APART`` apart, as the values are then one cluster."""
    threshold, apart = float(values.mean()), 0.0
    for _ in range(32):
        high = values > threshold
        if not high.any() or high.all():
            break
        upper, lower = values[high].mean(), values[~high].mean()
        apart, moved = upper - lower, (upper + lower) / 2
        if abs(moved - threshold) < 1e-9:
            break
        threshold = float(moved)
    return threshold if apart >= APART else float(values.min())


def main_text(html: str | None) -> str:
    """Blocks of the article in page order, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    parent, tag_of, n = parser.parent, parser.tag_of, len(parser.parent)
    place = np.array([x[3] for x in lines])

    def inherited(own: list[bool]) -> np.ndarray:
        out = np.array(own)
        for k in range(1, n):  # an element comes after its parent
            out[k] |= out[parent[k]]
        return out

    never = inherited(parser.never)
    heard = ~(never | inherited(parser.named))[place]
    if not heard.any():  # a page inside a form, or one whose names mislead
        heard = ~never[place]
        if not heard.any():
            return ""
    sizes = np.array([len(x[0]) for x in lines], float)
    linked = np.array([x[2] for x in lines]) >= LINKED * sizes
    own_ratio = np.where(heard, np.log1p(sizes / np.maximum(1, [x[1] for x in lines])), 0.0)
    ratio = np.zeros(len(lines))
    ratio[heard] = smooth(own_ratio[heard])
    threshold = two_clusters(ratio[heard])
    selected = heard & (ratio >= threshold)
    if not selected.any():
        selected = heard

    def under(values: np.ndarray) -> np.ndarray:
        """Sums of lines' values over each element and all that it holds."""
        out = np.bincount(place, values, n)
        for k in range(n - 1, 0, -1):
            out[parent[k]] += out[k]
        return out

    weight = under(np.where(selected, sizes, 0.0))
    # lists of links, none of which is a region by itself, are menus
    other = under((heard & ~(linked & (own_ratio < threshold))).astype(float)) > 0
    menu = inherited([bool(m >= LINK_LINES and not o) for o, m in zip(other, under(heard.astype(float)), strict=True)])
    kept = heard & ~menu[place]
    # articles that hold a region, or that are as long as others are; teasers are not
    text = under(np.where(kept, sizes, 0.0))
    article = np.array([t == "article" for t in tag_of])
    within = inherited(article.tolist())
    outermost = article & ~np.array([k > 0 and bool(within[parent[k]]) for k in range(n)])
    outermost &= (weight > 0) | (text >= PEER * max(text[outermost], default=0.0)) & (text > 0)
    if weight[outermost].sum() >= MAJORITY * weight[0]:
        inside = inherited(outermost.tolist())
        return "\n\n".join(lines[i][0] for i in np.flatnonzero(kept & inside[place]))
    home = 0
    for k in range(1, n):
        if parent[k] == home and weight[k] >= MAJORITY * weight[0]:
            home = k
    inside = inherited([k == home for k in range(n)])
    own = np.flatnonzero(kept & inside[place])
    chosen = np.flatnonzero(selected & inside[place])
    # no article elements: from the first to the last region, with headings before and plain paragraphs behind, without
    # lines that are mostly links
    first, last = int(chosen[0]), int(chosen[-1])
    while first > 0 and kept[first - 1] and inside[place[first - 1]] and tag_of[place[first - 1]] in HEADINGS:
        first -= 1
    while last + 1 < len(lines) and kept[last + 1] and inside[place[last + 1]] and tag_of[place[last + 1]] == "p" and not lines[last + 1][2]:
        last += 1
    return "\n\n".join(lines[i][0] for i in own if first <= i <= last and (lines[i][2] <= 0.5 * sizes[i] or selected[i]))


RESULT = "page_id long, url string, text string, n_chars long"


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    Defined results: null, empty or textless html gives an empty text with n_chars 0; null ids and urls are kept;
    repeated rows come out once each; other columns are ignored.
    """
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), sizes], schema=schema)

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(extract, RESULT)
