"""Main text of web pages by the text-to-tag ratio of their lines.

A page streams through the standard library's parser, whose events cut it into lines: a line is the text between two
block-level tags. A line's ratio is its characters over the tags met in it and around it; links, and what stands inside
menus, headers, footers, sidebars, forms, adverts, notices and reader comments, count as tags and not as text. The ratios
are smoothed with a Gaussian over neighbouring lines and clustered in two by a threshold (the two means of their
logarithms). The content regions are the outermost article and main elements that hold most text of the upper cluster's
lines, each of them at least a tenth of the largest one's; where such elements do not hold most of it, the innermost
container that nearly all of these lines share. A region's own lines are the text, short ones too, and what is marked as
boilerplate inside it stays out.

A class, id or role name, or a form, marks an element only by likelihood: such a mark does not reach into the outermost
article or main element, nor does it hold where the element has most of the text that the ratios alone put in the upper
cluster, unless an article or main element with text stands beside it. Boilerplate tags and hidden elements are always left out.

Elements whose text isn't shown (scripts, templates, buttons, lists of choices) stay silent up to their end tag. The head ends
at the first tag or text that can't stand in it. Where another silent element has no end tag, only what comes before the first
block tag in it is silent, so none takes the rest of a page with it.

Cases: null, empty or text-less html gives an empty text; unclosed and misnested tags are closed as the parser meets
others; plain text without tags is one line and is the text; rows that repeat a page_id are judged each by itself; of equal
regions all stay, in page order; no pages give no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm._text import over_texts

SIGMA = 1.5
#: A further content region has at least this part of the text that the largest one has in the upper cluster.
PART = 10
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button datalist".split())
#: What can stand in a head.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
#: An end tag of a silent element reaches up to one of these.
SILENT_SCOPES = frozenset("table td th caption html body article main".split())
FOREIGN = frozenset(("svg", "math"))
BOILERPLATE = frozenset("nav header footer aside menu dialog".split())
#: Words of class, id and role values that mark boilerplate.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|banner|sponsor|sponsored|promo|promoted|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|aside|footer|header|masthead|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|share|sharing|social|related|recommended|comment|comments|disqus|replies|widget|toolbar|pagination|pager|login|signup|search|complementary|contentinfo|alert)(?:$|[\s_-])", re.I)
CONTENT = frozenset(("article", "main"))
#: Elements that can be a content region; others hold a piece of text.
CONTAINERS = frozenset("body html div section center table tbody tr td".split())
#: An open <p> ends where one of these begins.
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "summary"}
SCOPES = frozenset("table td th button caption article section div main body".split())
WHITE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Collects lines: (text, link characters, tags, path of block elements, boilerplate, elements marked by name)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, tuple[int, ...], bool, tuple[int, ...]]] = []
        self.raw: list[tuple] = []  # lines before it is known which silent elements have an end tag
        self.stack: list[tuple[str, int, bool, tuple[int, ...], tuple[int, ...]]] = []  # tag, number, boilerplate, silent elements, elements marked by name
        self.kinds: dict[int, str] = {0: ""}
        self.parts: list[tuple[str, bool, tuple[int, ...]]] = []  # text, in a link, silent elements
        self.tags, self.in_link = 0, 0
        self.ended: set[int] = set()  # silent elements with an end tag
        self.broken: set[int] = set()  # silent elements in which a block tag was met
        self.plain = True

    def end_line(self) -> None:
        if self.parts:
            path = tuple(n for tag, n, *_ in self.stack if tag in BLOCKS)
            self.raw.append((self.parts, self.tags, path, bool(self.stack) and self.stack[-1][2], self.stack[-1][4] if self.stack else ()))
            self.tags, self.parts = 0, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.plain = False
        self.tags += 1
        silent = self.stack[-1][3] if self.stack else ()
        if silent and (tag == "body" or tag not in IN_HEAD and self.kinds[silent[-1]] == "head"):
            self.close_element("head")
        if tag in ("button", "select"):
            self.close_element(tag, SILENT_SCOPES)
        if tag in BLOCKS:
            self.end_line()
            self.broken.update(self.stack[-1][3] if self.stack else ())
            if tag in ENDS_P:
                self.close_element("p", SCOPES)
            if tag == "li":
                self.close_element("li", frozenset(("ul", "ol", "menu")))
            elif tag in ("dt", "dd"):
                self.close_element("dt", frozenset(("dl",)))
                self.close_element("dd", frozenset(("dl",)))
        if tag in VOID:
            return
        under = self.stack[-1] if self.stack else ("", 0, False, (), ())
        marked = under[2] or tag in BOILERPLATE
        number, named = len(self.kinds), under[4]
        if tag in CONTENT:
            if named and not any(x[0] in CONTENT for x in self.stack):
                named = ()
        elif not marked and tag not in ("html", "body"):
            marked = any(k == "hidden" for k, _ in attrs)
            if tag == "form" or any(v and k in ("class", "id", "role", "aria-label") and MARKS.search(v) for k, v in attrs):
                named = (*named, number)
        self.in_link += tag == "a"
        self.kinds[number] = tag
        self.stack.append((tag, number, marked, (*under[3], number) if tag in SILENT else under[3], named))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        foreign = tag in FOREIGN or tag not in BLOCKS and any(x[0] in FOREIGN for x in self.stack)
        self.handle_starttag(tag, attrs)  # as browsers do, <div/> opens an element
        if foreign and tag not in VOID:
            self.close_element(tag, by_tag=True)

    def close_element(self, tag: str, scopes: frozenset[str] = frozenset(), by_tag: bool = False) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            name, number, *_ = self.stack[i]
            if name == tag:
                if by_tag:
                    self.ended.add(number)
                for gone, *_ in self.stack[i:]:
                    self.in_link -= gone == "a"
                del self.stack[i:]
                return
            if name in scopes:
                return

    def handle_endtag(self, tag: str) -> None:
        self.plain = False
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            self.broken.update(self.stack[-1][3] if self.stack else ())
        if tag not in VOID:
            # an inline end tag does not close the blocks around it
            self.close_element(tag, frozenset() if tag in BLOCKS else SILENT_SCOPES if tag in SILENT else BLOCKS, by_tag=True)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self.close_element("head")
        silent = self.stack[-1][3] if self.stack else ()
        if silent and not self.broken.issuperset(silent):
            return
        self.parts.append((data, self.in_link > 0, silent))

    def finish(self) -> None:
        self.close()
        self.end_line()
        before = 0  # tags of lines without text count for the next one
        for parts, tags, path, marked, named in self.raw:
            shown = [(t, link) for t, link, silent in parts if not any(n in self.ended for n in silent)]
            text = WHITE.sub(" ", "".join(t for t, _ in shown)).strip()
            before += tags
            if text:
                self.lines.append((text, sum(len(t) for t, link in shown if link), before, path, marked, named))
                before = 0


def smoothed(values: list[float], sigma: float) -> list[float]:
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(values), i + reach + 1)):
            w = weights[j - i + reach]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The middle of the two means that values fall to (one cluster: below all)."""
    lo, hi = min(values), max(values)
    if hi - lo < 1e-9:
        return lo - 1
    for _ in range(20):
        cut = (lo + hi) / 2
        low, high = [v for v in values if v <= cut], [v for v in values if v > cut]
        new = sum(low) / len(low), sum(high) / len(high)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def evened(lines: list[tuple], out: list[bool], sigma: float) -> list[float]:
    """Logarithms of the smoothed ratios; lines that are left out have none."""
    ratio = [0.0 if gone else max(len(x[0]) - x[1], 0) / max(x[2], 1) for x, gone in zip(lines, out, strict=True)]
    return [math.log1p(v) for v in smoothed(ratio, sigma)]


def left_out(lines: list[tuple], kinds: dict[int, str], sigma: float) -> list[bool]:
    """Whether each line is boilerplate: by a tag, or by a mark on an element that lacks most of the upper cluster's text."""
    out = [x[4] for x in lines]
    if not any(x[5] for x in lines):
        return out
    even = evened(lines, out, sigma)
    cut = threshold(even)
    high = [i for i, v in enumerate(even) if v > cut and not out[i]]
    sizes = {i: max(len(lines[i][0]) - lines[i][1], 0) for i in high}
    held: dict[int, int] = {}
    for i in high:
        for n in lines[i][5]:
            held[n] = held.get(n, 0) + sizes[i]
    total = sum(sizes.values())
    # beside an article or main element with text, an outer element keeps its mark however long it is
    contents = [[n for n in x[3] if kinds[n] in CONTENT] for x in lines]
    for m in [m for m, n in held.items() if n * 2 > total]:
        within = any(m in x[5] and c and c[0] < m for x, c in zip(lines, contents, strict=True))
        if not within and any(c and m not in x[5] and not x[4] for x, c in zip(lines, contents, strict=True)):
            held[m] = 0
    return [gone or any(held.get(n, 0) * 2 <= total for n in x[5]) for x, gone in zip(lines, out, strict=True)]


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.finish()
    lines = [(*x[:4], out) for x, out in zip(parser.lines, left_out(parser.lines, parser.kinds, sigma), strict=True)]
    usable = [i for i, x in enumerate(lines) if not x[4]]
    if not usable:
        return ""
    even = evened(lines, [x[4] for x in lines], sigma)
    cut = threshold(even)
    high = [i for i in usable if even[i] > cut] or usable
    # the regions: the outermost article and main elements that hold a good part of the upper cluster's text, where these have
    # most of it; else the block that the cluster shares
    weight: dict[int, int] = {}
    outer = {i: next((n for n in x[3] if parser.kinds[n] in CONTENT), 0) for i, x in enumerate(lines)}
    for i in high:
        if outer[i]:
            weight[outer[i]] = weight.get(outer[i], 0) + len(lines[i][0])
    total = sum(len(lines[i][0]) for i in high)
    if weight and sum(weight.values()) * 2 >= total:
        regions = {n for n, w in weight.items() if w * PART >= max(weight.values())}
        kept = [i for i in usable if outer[i] in regions]
    else:
        shared: dict[int, int] = {}
        for i in high:
            for n in lines[i][3]:
                if parser.kinds[n] in CONTAINERS:
                    shared[n] = shared.get(n, 0) + len(lines[i][0])
        region = max((n for n, w in shared.items() if w * 10 >= total * 9), default=0)
        inside = [i for i in usable if not region or region in lines[i][3]]
        first, last = min(high), max(high)
        kept = [i for i in inside if region and parser.kinds[region] not in ("body", "html") or first <= i <= last or lines[i][1] * 2 < len(lines[i][0])]
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", sigma: float = SIGMA) -> DataFrame:
    """A row for each page: page_id, url, text and n_chars."""

    def work():
        def f(batch: pa.RecordBatch) -> dict:
            texts = [main_text(x, sigma) for x in batch["text"].to_pylist()]
            return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]}

        return f

    return over_texts(pages, {"page_id": page_id, "url": url, "text": html}, "page_id bigint, url string, text string, n_chars bigint", work)


def op6_extract(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
