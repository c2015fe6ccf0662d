"""Operator 1: main text of HTML pages.

The standard library's streaming parser turns a page into *lines*, one for each
block of text, with the number of tags seen since the line before. The ratio of
text to tags of each line is smoothed with a Gaussian (as a logarithm), and a threshold
between two clusters splits the lines into content and the rest. The content lines select a
*region*: article or main elements if they hold most of the content, else the smallest
element that holds all content lines. All lines of the region are returned, short ones too, and
so are content lines outside it; lines inside boilerplate elements are not. Lines
that mainly consist of links neither widen the region nor are added to it.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Fixed values of HTML: elements that stay inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
#: Elements whose text never belongs to the article.
DROPPED = frozenset(
    "head title script style noscript template nav header footer aside button select option textarea input dialog iframe object svg canvas audio video map menu".split()
)
#: An end tag is implied for these when one of the same list opens.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
#: Words in class, id or role that mark menus, adverts, notices, sidebars and reader comments.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsored promo promoted
    nav navbar navigation submenu breadcrumb breadcrumbs pager pagination footer sidebar
    comment comments commentlist disqus cookie cookies consent gdpr popup modal newsletter subscribe signup complementary contentinfo""".split()
)
#: Words that mark the same, but also stand for topics and parts of articles.
WEAK = frozenset(
    """banner sponsor promotion menu header masthead aside rail widget widgets discussion replies notice notices alert overlay
    subscription login form search share sharing social related recommended recommendations skip toolbar""".split()
)
#: Words that stand beside weak ones in names of parts of a page.
PARTS = frozenset("area bar block box button buttons container icon icons inner item items left link links list module outer panel posts right section stories top wrap wrapper".split())
#: Words that make a name one of the page's layout, as has-sidebar, and those that do so at its end, as form-page.
LAYOUT, LAYOUT_END = frozenset("has with without no".split()), frozenset("page layout template theme enabled".split())
#: Words of marks that never wrap the article.
COMMENTS = frozenset("comment comments commentlist disqus".split())
#: Lists and such, which an id may mark besides containers.
GROUPS = frozenset("ul ol dl table fieldset form".split())
#: Elements that can be the region; paragraphs, headings, lists and tables are parts of one.
CONTAINERS = frozenset("html body main article section div center td".split())
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Headings and their ranks.
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Words from which on a line is prose: if its own ratio is near the threshold, this decides for it.
PROSE = 10
#: Shares of the threshold: what a content line's own ratio has at least, and from where on a line is near it.
OWN, NEAR = 0.1, 0.7
#: Characters a tag beyond which no threshold lies, however long the longest lines of the page are.
CEILING = 60.0
#: Elements that are too wide to be boilerplate whatever their class says.
_WIDE = frozenset(["html", "body", "main", "article"])
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_COMMENT_END = re.compile(r"--!?>")
_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*")
#: Decimal character references of more digits than any character has.
_LONG_REFERENCE = re.compile(r"&#(\d{8,});?")


def mark_of(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """How names mark an element: form, comments, strong, weak, weak-id, or '' if they don't."""
    if tag == "form":
        return "form"
    if tag in _WIDE:
        return ""
    found = set()
    for k, v in attrs:
        if not v or k not in ("class", "id", "role") or (k == "id" and tag in HEADINGS):
            continue
        for token in v.split():
            in_order = [w.lower() for w in _NAME.findall(token)]
            words = set(in_order)
            if not words.isdisjoint(LAYOUT) or LAYOUT_END.issuperset(in_order[-1:]):
                continue
            if not words.isdisjoint(MARKED):
                found.add("strong" if words.isdisjoint(COMMENTS) else "comments")
            elif not words.isdisjoint(WEAK) and words <= WEAK | PARTS and (k != "id" or tag in CONTAINERS or tag in GROUPS):
                found.add("weak-id" if k == "id" else "weak")
    return next((kind for kind in ("comments", "strong", "weak", "weak-id") if kind in found), "")


@dataclass
class Line:
    """One block of text: the tags before it, whether boilerplate holds it, its links and its rank."""

    text: str
    tags: int
    dropped: bool
    linked: int = 0  # characters inside links, without white space
    rank: int = 0  # 1 to 6 for headings

    @property
    def is_links(self) -> bool:
        return 2 * self.linked > len(self.text)

    @property
    def is_prose(self) -> bool:
        return len(self.text.split()) >= PROSE


@dataclass
class Page:
    """Lines and the block elements in the order of their start, each with the lines that it holds: those from ``lo`` to before ``hi``."""

    lines: list[Line]
    names: list[str]
    marks: dict[int, str]  # kind of mark by number of the element
    lo: np.ndarray
    hi: np.ndarray

    def only(self, kept: np.ndarray) -> Page:
        """The page with the lines that ``kept`` marks."""
        before = np.concatenate(([0], np.cumsum(kept)))
        return Page([x for x, k in zip(self.lines, kept, strict=True) if k], self.names, self.marks, before[self.lo], before[self.hi])

    def within(self, *names: str) -> np.ndarray:
        """Which lines are in an element of one of these names."""
        steps = np.zeros(len(self.lines) + 1, np.int64)
        for n, name in enumerate(self.names):
            if name in names:
                steps[self.lo[n]] += 1
                steps[self.hi[n]] -= 1
        return np.cumsum(steps)[:-1] > 0


class WholePage(HTMLParser):
    """The standard parser for a page that is fed as a whole: no markup makes it raise, and it tells comments from text as browsers do.

    A comment ends at ``-->`` or ``--!>``; ``<!-->`` and ``<!--->`` are empty ones. Other declarations and
    processing instructions end at the next ``>``, whatever they hold. What the end of the page cuts off is
    no text. Inside script, style, textarea and the like only their own end tag is markup; where it is missing, script and style
    take the rest, the others only their start tag. A malformed start tag ends at the next ``>``.
    """

    CDATA_CONTENT_ELEMENTS = tuple("script style textarea title iframe noembed noframes xmp".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.last_end: dict[str, int] = {}  # where the last end tag of an element begins

    def feed(self, data: str) -> None:
        super().feed(_LONG_REFERENCE.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or '0'};", data))

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def set_cdata_mode(self, elem: str) -> None:
        if elem not in ("script", "style"):
            if elem not in self.last_end:
                ends = [m.start() for m in re.finditer(rf"</{elem}(?=[\s/>])", self.rawdata, re.I)]
                self.last_end[elem] = ends[-1] if ends else -1
            if self.last_end[elem] < self.at:
                return
        self.cdata_elem = elem
        self.interesting = re.compile(rf"</{elem}(?=[\s/>])", re.I)

    def _to(self, mark: str, i: int) -> int:
        """The place after the next ``mark``, or the end of the page."""
        end = self.rawdata.find(mark, i)
        return end + len(mark) if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self._to(">", i + 2)

    parse_pi = parse_html_declaration

    def parse_starttag(self, i: int) -> int:
        self.at = i
        end = self.check_for_whole_start_tag(i)
        if end > 0 and self.rawdata[end - 1] == ">":
            return super().parse_starttag(i)
        stop = self.rawdata.find(">", max(end, i + 1))
        if stop < 0:
            return len(self.rawdata)
        tag = _TAG_NAME.match(self.rawdata, i + 1)[0].lower()
        self.handle_starttag(tag, [])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return stop + 1

    def parse_endtag(self, i: int) -> int:
        name = _TAG_NAME.match(self.rawdata, i + 2)
        if name:
            self.clear_cdata_mode()  # only its own end tag is looked for in that mode
            end = self._to(">", name.end())
            if self.rawdata[end - 1] == ">":
                self.handle_endtag(name[0].lower())
            return end
        return self._to(">", i + 2)


class Lines(WholePage):
    """Parser events to lines. Whatever an event asks of the open elements is kept up to date, so that the time doesn't grow with their depth."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[Line] = []
        self.names: list[str] = []  # element name by number
        self.marks: dict[int, str] = {}  # kind of mark by number
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.stack: list[tuple[str, int, bool]] = []  # open elements: name, number (-1: inline), boilerplate
        self.open: dict[str, list[int]] = defaultdict(list)  # places in the stack by name
        self.blocks: list[int] = []  # places of block elements
        self.wide: list[int] = []  # places of wide ones
        self.ranks: list[int] = []  # ranks of open headings
        self.literal = 0  # open headings and code
        self.boilerplate = 0
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def _flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.lines.append(Line(text, self.tags, self.boilerplate > 0, self.linked, self.ranks[-1] if self.ranks else 0))
            self.tags = 0
        self.linked = 0

    def _push(self, tag: str, number: int, out: bool) -> None:
        place = len(self.stack)
        self.stack.append((tag, number, out))
        self.open[tag].append(place)
        if number >= 0:
            self.blocks.append(place)
        if tag in _WIDE:
            self.wide.append(place)
        if tag in HEADINGS:
            self.ranks.append(HEADINGS[tag])
        self.literal += tag in HEADINGS or tag in ("pre", "code")
        self.boilerplate += out

    def _pop(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, number, out = self.stack.pop()
            self.open[tag].pop()
            if number >= 0:
                self.blocks.pop()
                self.hi[number] = len(self.lines)
            if tag in _WIDE:
                self.wide.pop()
            if tag in HEADINGS:
                self.ranks.pop()
            self.literal -= tag in HEADINGS or tag in ("pre", "code")
            self.boilerplate -= out

    def _end_head(self, tag: str) -> None:
        """The end tag of head is optional: ``tag`` ('' for text) ends an open one that it may not stand in."""
        if self.open["head"] and tag not in IN_HEAD:
            k = self.open["head"][0]
            held = self.open["template"] and self.open["template"][-1] > k
            if k == len(self.stack) - 1 or (tag == "body" and not held):
                self._flush()
                self._pop(k)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._end_head(tag)
        self.tags += 1
        block = tag not in INLINE
        if tag == "br":
            self.parts.append("\n")
        if block:
            self._flush()
            # a block ends an open paragraph, and a list item or cell ends its predecessor
            if self.blocks and self.stack[self.blocks[-1]][0] in CLOSES.get(tag, frozenset()) | {"p"}:
                self._pop(self.blocks[-1])
        if tag in VOID:
            return
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        kind = mark_of(tag, attrs)
        # an inline element is a small part of its line; in headings and code, names mean other things
        out = tag in DROPPED or hidden or (not block and kind in ("strong", "comments") and not self.literal)
        number = -1
        if block:
            number = len(self.names)
            self.names.append(tag)
            self.lo.append(len(self.lines))
            self.hi.append(len(self.lines))
            if kind:
                self.marks[number] = kind
        elif out:
            self._flush()
        self._push(tag, number, out)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.open[tag]:
            k = self.open[tag][-1]
            if tag in INLINE and self.wide and self.wide[-1] > k:
                return  # an inline end tag closes nothing beyond its region
            if self.stack[k][1] >= 0 or self.stack[k][2]:
                self._flush()
            self._pop(k)
        elif tag == "p" or tag not in INLINE:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head("")
        self.parts.append(data)
        if self.open["a"]:
            self.linked += len("".join(data.split()))

    def page(self) -> Page:
        """The lines outside elements that never belong to an article."""
        self.close()
        self._flush()
        self._pop(0)
        whole = Page(self.lines, self.names, self.marks, np.array(self.lo, np.int64), np.array(self.hi, np.int64))
        return whole.only(np.array([not x.dropped for x in self.lines], bool))


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; weights that would lie outside are left out and the rest scaled up."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def content_lines(lines: list[Line], sigma: float = 1.0) -> list[bool]:
    """Which lines form the high cluster of smoothed text-to-tag ratios.

    Ratios count by their logarithm, so that a few very long lines don't outweigh
    the rest. Starts from the mean as threshold and moves it halfway between the two
    clusters' means until it stays (two-means in one dimension), but not above ``CEILING``. A line whose own
    ratio is below ``OWN`` of the threshold is not lifted above it by its neighbours; one of
    ``PROSE`` words whose own ratio is from ``NEAR`` of it on is content, too.
    """
    own = [math.log(len(x.text) / max(1, x.tags)) for x in lines]
    ratios = smooth(own, sigma)
    if not ratios:
        return []
    cut = sum(ratios) / len(ratios)
    for _ in range(50):
        high = [r for r in ratios if r >= cut]
        low = [r for r in ratios if r < cut]
        if not high or not low:
            break
        new = (sum(high) / len(high) + sum(low) / len(low)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    cut = min(cut, math.log(CEILING))
    lifted, near = cut + math.log(OWN), cut + math.log(NEAR)
    return [(r >= cut and x >= lifted) or (x >= near and line.is_prose) for r, x, line in zip(ratios, own, lines, strict=True)]


def unmarked(page: Page, sigma: float, share: float) -> Page:
    """``page`` without the lines of marked elements that are boilerplate by their content too.

    Outer elements are judged first. An element that holds half of the page's text, and
    ``share`` of it and what no mark holds, is a wrapper of the article and stays, unless
    an article or main lies outside all marks, or comments mark it and any other text is left.
    A form without prose is none. Of the others strong marks, comments and forms go. Weak ones
    go if they are mainly links or have no content line, or, unless an id alone marks them, hold
    less than 1 - ``share`` of the content; those that an id alone marks stay if they have a heading.
    """
    lines = page.lines
    spans = {n: (int(page.lo[n]), int(page.hi[n])) for n in page.marks if page.hi[n] > page.lo[n]}
    if not spans:
        return page
    live = set(spans)
    cover = np.zeros(len(lines), np.int64)  # live marked elements around each line
    for lo, hi in spans.values():
        cover[lo:hi] += 1
    size_of = np.array([len(x.text) for x in lines])
    content = np.array(content_lines(lines, sigma)) if any(page.marks[n].startswith("weak") for n in spans) else np.zeros(len(lines), bool)
    sums = lambda x: np.concatenate(([0], np.cumsum(x))).tolist()
    sizes, links, helds = sums(size_of), sums([x.linked for x in lines]), sums(size_of * content)
    ranked, prose = sums([x.rank > 0 for x in lines]), sums([x.rank > 0 or x.is_prose for x in lines])
    article = page.within("article", "main")
    total, weight = sizes[-1], helds[-1]
    out = np.zeros(len(lines), bool)
    for n in sorted(spans):
        lo, hi = spans[n]
        if out[lo]:
            continue  # inside one that goes
        kind, size = page.marks[n], sizes[hi] - sizes[lo]
        if kind.startswith("weak"):
            held = helds[hi] - helds[lo]
            go = 2 * (links[hi] - links[lo]) > size or not held or held < (1 - share) * weight
            if kind == "weak-id":
                go = 2 * (links[hi] - links[lo]) > size or (not held and ranked[hi] == ranked[lo])
        else:
            go = 2 * size < total
            if not go:
                if n in live:
                    live.discard(n)
                    cover[lo:hi] -= 1
                rest = cover == 0
                rest[lo:hi] = False
                left = int(size_of[rest].sum())
                go = size < share * (size + left) or bool(article[rest].any())
                go = go or (kind == "comments" and left > 0)
                go = go or (kind == "form" and prose[hi] == prose[lo])
        if go:
            out[lo:hi] = True
            if n not in live:
                live.add(n)
                cover[lo:hi] += 1
        elif n in live:
            live.discard(n)
            cover[lo:hi] -= 1
    return page.only(~out)


def region(page: Page, content: list[bool]) -> list[Line]:
    """The lines of the article, given which lines are content."""
    lines = page.lines
    if not lines:
        return []
    chosen = np.array([c and not x.is_links for x, c in zip(lines, content, strict=True)], bool)
    if not chosen.any():
        chosen = np.array(content, bool)
    size_of = np.array([len(x.text) for x in lines])
    for kind in ("article", "main"):
        within = page.within(kind)
        if (chosen & within).any() and 2 * size_of[chosen & within].sum() >= size_of[chosen].sum():
            taken = chosen | within
            for k in range(len(lines) - 2, -1, -1):  # a heading goes with what it heads
                after = lines[k + 1]
                taken[k] |= bool(lines[k].rank) and taken[k + 1] and (not after.rank or after.rank > lines[k].rank)
            return [x for x, t in zip(lines, taken, strict=True) if t]
        chosen = chosen | within
    held = np.concatenate(([0], np.cumsum(chosen)))
    whole = np.flatnonzero(held[page.hi] - held[page.lo] == held[-1])
    holder = next((n for n in whole[::-1].tolist() if page.names[n] in CONTAINERS), None)
    if holder is None or not held[-1]:
        return lines
    lo, hi = int(page.lo[holder]), int(page.hi[holder])
    while lo and lines[lo - 1].rank and (not lines[lo].rank or lines[lo].rank > lines[lo - 1].rank):
        lo -= 1  # so does the heading before a region
    return lines[lo:hi]


def main_text(html: str | None, sigma: float = 1.0, share: float = 0.9) -> str:
    """The article of one page; blocks in page order joined by an empty line. Null and empty pages give ''."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    page = unmarked(parser.page(), sigma, share)
    return "\n\n".join(x.text for x in region(page, content_lines(page.lines, sigma)))


def extract_main_text(pages: DataFrame, html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """``pages`` with ``text`` (main text, '' if none) and ``n_chars`` (its code points) added.

    A null page gives an empty text; every row gives a row, repeated ones too. Malformed
    markup never fails and hides no more than browsers do (``WholePage``). Pages are read whole, however long or deeply nested; the time is in proportion to their length.
    Columns of ``pages`` named text or n_chars are replaced. Empty tables give no rows.
    """

    @F.pandas_udf("string")
    def of(html: pd.Series) -> pd.Series:
        return html.map(lambda x: main_text(x, sigma))

    kept = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars", html_col)], of(F.col(html_col)).alias("text"))
    return kept.withColumn("n_chars", F.char_length("text").cast("long"))
