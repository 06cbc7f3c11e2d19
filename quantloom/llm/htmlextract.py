"""Main text of web pages from a stream of parser events.

The standard library's parser gives events, from which lines are made: one for each block of text, with the tags met
since the line before. Each line's text-to-tag ratio is smoothed by a Gaussian over its neighbours; a threshold that
splits the ratios into two clusters marks content lines. The smallest section that holds all of them, widened to the
article or main element around it, is the content region, and all its lines are taken in page order, with the title
before it.

What stands in navigation, page headers, footers, asides, forms, scripts and styles never becomes a line. A class, id or
role that names an advert, a notice, a menu, a sidebar or reader comments makes an element suspect, no more: whether it
goes is decided after the clusters. An element around half or more of the content lines' characters stays if a title or
article is in it, or none is on the page, or nearly all of the page is in it, as it is a wrapper of the article
(``layout sidebar-left``); the others go. Names with words like no, with or enabled (``no-sidebar``) say nothing.

Null and empty pages give an empty text, an empty table no rows. A cut-off last tag is dropped. Repeated rows give equal
texts; other columns are not read. A page is read on its own, in time linear in its length and whatever the depth of its
elements: no shuffle, memory bounded by one Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_arrow

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SECTIONS = frozenset("article main section div body td".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg object dialog menu".split())
#: What can stand in a head.
HEAD = frozenset("base link meta title style script noscript template".split())
#: Elements whose class or id decides nothing.
NEVER_SUSPECT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class or id that name what is not the article.
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense banner promo promoted sponsor sponsored popup modal cookie cookies consent notice notices alert gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar related recommended share sharing social newsletter subscribe signup login search widget toolbar pagination pager".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Words that say whether something is there, not what the element is.
MODIFIERS = frozenset("no not non without with has have is enabled disabled enable disable hide hidden show".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_CUT = re.compile(r"<[!/?a-zA-Z][^<>]*\Z")


@dataclass
class Line:
    text: str
    tags: int
    section: int
    suspect: int
    title: bool = False


@dataclass
class Suspect:
    """An element whose name speaks against it."""

    above: int
    comments: bool
    #: Titles and articles in it, and characters of content lines and of all lines.
    marks: int = 0
    mass: int = 0
    size: int = 0


@dataclass
class _Open:
    tag: str
    section: int
    noise: bool
    suspect: int
    title: bool
    article: bool


def _named(value: str) -> tuple[bool, bool]:
    """Whether a class or id names what is not the article, and whether reader comments."""
    noise = comments = False
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if MODIFIERS.isdisjoint(words):
            comments = comments or not COMMENT_WORDS.isdisjoint(words)
            noise = noise or not NOISE_WORDS.isdisjoint(words)
    return noise or comments, comments


class LineMaker(HTMLParser):
    """Collects lines while events come in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = 0
        self.parents = [0]
        self.kinds = ["page"]
        self.suspects = [Suspect(0, False)]
        self.stack = [_Open("", 0, False, 0, False, False)]
        self.open = Counter()

    def _suspect(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        if tag in NEVER_SUSPECT:
            return False, False
        found = comments = False
        for name, value in attrs:
            if value and name in ("class", "id"):
                own, about = _named(value)
                # an article is none of the page's furniture, but can be a comment
                found, comments = found or (about if tag == "article" else own), comments or about
        return found, comments

    def flush_line(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            at = self.stack[-1]
            self.lines.append(Line(text, self.tags, at.section, at.suspect, at.title))
            self.tags = 0
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag not in HEAD and self.open["head"]:
            self._end_head(tag)
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.open[tag]:
            self._end_open(tag)
        above = self.stack[-1]
        section, suspect = above.section, above.suspect
        noise = above.noise or tag in DROPPED or tag == "header" and not above.article
        noise = noise or any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and (value or "").lower() in NOISE_ROLES for name, value in attrs)
        if not noise:
            if tag in SECTIONS:
                section = len(self.parents)
                self.parents.append(above.section)
                self.kinds.append(tag)
            found, comments = self._suspect(tag, attrs)
            if found:
                suspect = len(self.suspects)
                self.suspects.append(Suspect(above.suspect, comments))
            elif tag in ("article", "main", "h1"):
                self.suspects[suspect].marks += 1
        article = above.article or tag == "main" or tag == "article" and suspect == above.suspect
        self.open[tag] += 1
        self.stack.append(_Open(tag, section, noise, suspect, above.title or tag == "h1", article))

    def _cut(self, at: int) -> None:
        for x in self.stack[at:]:
            self.open[x.tag] -= 1
        del self.stack[at:]

    def _end_head(self, tag: str) -> None:
        """What can't stand in a head ends one without its end tag; the body does so from within any element."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == "head":
                self._cut(i)
                return
            if tag != "body":
                return

    def _end_open(self, tag: str) -> None:
        """A new paragraph or item ends one that is still open in the same block."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                self._cut(i)
                return
            if self.stack[i].tag in BLOCKS:
                return

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush_line()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush_line()
        if self.open[tag]:
            at = len(self.stack) - 1
            while self.stack[at].tag != tag:
                at -= 1
            self._cut(at)

    def handle_data(self, data):
        if not self.stack[-1].noise:
            self.parts.append(data)

    def gone(self) -> list[bool]:
        """By suspect: whether its lines go. Their characters are counted before."""
        for x in reversed(self.suspects[1:]):
            self.suspects[x.above].mass += x.mass
            self.suspects[x.above].size += x.size
            if not x.comments:
                self.suspects[x.above].marks += x.marks
        page, out = self.suspects[0], [False]
        for x in self.suspects[1:]:
            alone = page.marks == 0 or 10 * x.size >= 9 * page.size
            around = 2 * x.mass >= page.mass and (x.marks > 0 or alone and not x.comments or page.marks == 0 and x.mass == page.mass)
            out.append(out[x.above] or not around)
        return out

    def last_within(self) -> list[int]:
        """By section: the last section in it. Sections are numbered as they begin, so those in one follow it."""
        out = [*range(len(self.parents))]
        for s in range(len(out) - 1, 0, -1):
            out[self.parents[s]] = max(out[self.parents[s]], out[s])
        return out


@dataclass(frozen=True)
class TagRatio:
    #: Width of the Gaussian, in lines.
    sigma: float = 1.0
    radius: int = 3


def smooth(ratios: list[float], how: TagRatio) -> list[float]:
    kernel = [math.exp(-0.5 * (d / how.sigma) ** 2) for d in range(how.radius + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for d in range(-how.radius, how.radius + 1):
            if 0 <= i + d < len(ratios):
                total += kernel[abs(d)] * ratios[i + d]
                weight += kernel[abs(d)]
        out.append(total / weight)
    return out


def two_means(values: list[float]) -> float:
    """The threshold midway between two cluster means; the least value if they are within a factor of two, as one cluster."""
    least = low, high = min(values), max(values)
    for _ in range(30):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below:
            return least[0]
        now = sum(below) / len(below), sum(above) / len(above)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2 if high > 2 * low else least[0]


def content_lines(lines: list[Line], how: TagRatio) -> list[Line]:
    """The lines whose smoothed text-to-tag ratio is in the upper cluster."""
    smoothed = smooth([len(x.text) / max(x.tags, 1) for x in lines], how)
    threshold = two_means(smoothed)
    return [x for x, ratio in zip(lines, smoothed, strict=True) if ratio >= threshold]


def extract(html: str | None, how: TagRatio | None = None) -> str:
    """The main text: blocks joined by an empty line."""
    how = how or TagRatio()
    if not html:
        return ""
    maker = LineMaker()
    maker.feed(_CUT.sub("", html) if html.rfind("<") > html.rfind(">") else html)
    maker.close()
    maker.flush_line()
    lines = maker.lines
    if not lines:
        return ""
    for line in content_lines(lines, how):
        maker.suspects[line.suspect].mass += len(line.text)
    for line in lines:
        maker.suspects[line.suspect].size += len(line.text)
    gone = maker.gone()
    lines = [x for x in lines if not gone[x.suspect]]
    if not lines:
        return ""
    # the smallest section around all content lines, widened to the article or main element around it
    content = {x.section for x in content_lines(lines, how)}
    last = maker.last_within()
    root, end = min(content), max(content)
    while last[root] < end:
        root = maker.parents[root]
    at = root
    while at and maker.kinds[at] not in ("article", "main"):
        at = maker.parents[at]
    root = at or root
    chosen = [i for i, x in enumerate(lines) if root <= x.section <= last[root]]
    # a title may stand before the section of its text
    titles = [i for i, x in enumerate(lines) if x.title and i < chosen[0]]
    if titles and not any(lines[i].title for i in chosen):
        chosen.insert(0, titles[-1])
    return "\n\n".join(lines[i].text for i in chosen)


def extract_main_text(pages: DataFrame, how: TagRatio | None = None, *, id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the ``keep`` columns and ``text`` of every row of ``pages``."""
    narrow = pages.select(F.col(id_column).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = pa.array([extract(x.as_py(), how) for x in part.column(n)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], texts], [*part.schema.names[:n], "text"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "html")
    out = map_arrow(narrow, run, f"{fields}, text string")
    return out.select(F.col("id").alias(id_column), *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text")
