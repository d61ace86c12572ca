"""Operator 2: main text of web pages by line-block distribution.

Markup is stripped so that each block of the page becomes a line; elements that are never part of
an article (menus, headers, footers, sidebars, notices, adverts, forms, comments) leave silent lines
in their place. The lengths of lines are summed over windows that slide down the page. The text
surges where a window passes a threshold, which the page's own windows set, and dives where the lines
fall silent; what lies between the two points is kept. An element that marks the article is evidence
of which lines are silent; the search is the same on every page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
#: Characters that a window must pass to be a surge, and the share of the page's largest window where that is less.
SURGE, SURGE_SHARE = 86, 0.5
#: Share of a line's characters that may be link text where no article is marked.
LINK_SHARE = 0.5
#: Share of a page's text that marked articles must hold for the marks to count.
MARKED_SHARE = 0.05

# Elements by their role in a page.
RAW_TEXT = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER = set("head nav aside footer form script style noscript template iframe svg math button select textarea object audio video canvas dialog menu datalist noembed noframes title xmp search".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
NAMES = set(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners sponsor sponsored promo promos promotion cookie cookies consent gdpr notice notices "
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars rail widget widgets related recommended share sharing social comment comments commentlist "
    "disqus replies respond footer masthead subscribe subscription newsletter signup popup modal overlay paywall login pagination pager skip".split()
)
#: Words that may stand beside those names in a class or id without making it the name of something else.
BESIDE = set(
    "area article articles banner bar block body bottom box btn button buttons card cards col column container content desktop fixed floating form global google group header icon icons id in inner "
    "item items js label layout left link links list main media message mobile module msg outer page panel parent popular post posts primary reader readers right row secondary section site slot small "
    "sticky stories story text the thread title to tools top ul unit user users view wide wrap wrapper x".split()
)

# Elements that a start tag ends where they have no end tag of their own.
_ROWS = {"tr", "tbody", "thead", "tfoot"}
_ENDED_BY = {
    "p": (BLOCKS - {"body", "caption", "head", "html"}),
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "optgroup": {"optgroup"},
    "td": {"td", "th", *_ROWS},
    "th": {"td", "th", *_ROWS},
    "tr": _ROWS,
    "tbody": _ROWS - {"tr"},
    "thead": _ROWS - {"tr"},
    "tfoot": _ROWS - {"tr"},
    "head": BLOCKS - {"head", "html"},
    **{h: HEADINGS for h in HEADINGS},
}
_FRAMES = (BLOCKS | NEVER) - VOID

_NAME = re.compile(r"[^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_BARE = re.compile(r"=[^\s\"'=]*/\Z")  # a slash at the end of a value without quotes
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_PARTS = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Mark:
    """A tag, or text (no tag). Of a start tag, ``end`` is the place of the mark that ends its element, ``closed`` whether by an end tag of its own."""

    tag: str = ""
    text: str = ""
    ending: bool = False
    empty: bool = False
    end: int = 0
    closed: bool = False


@dataclass
class Line:
    """A block's text; ``lead`` counts the silent lines before it, ``article`` numbers the marked article around it (0: none)."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    lead: int = 0
    article: int = 0
    heading: bool = False

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def scan(page: str) -> list[Mark]:
    """The page's tags and texts in order. One pass; every search starts where the last one ended."""
    out: list[Mark] = []
    at, done, missing = 0, len(page), set()

    def find(what: str, start: int) -> int:
        """As str.find; what isn't found once is not looked for again."""
        if what in missing:
            return -1
        place = page.find(what, start)
        if place < 0:
            missing.add(what)
        return place

    def tag_end(start: int) -> int:
        """The place of the > that ends a tag; a quote counts only after = and where it is closed."""
        while m := _STOP.search(page, start):
            start = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while before >= 0 and page[before] in " \t\n\r\f" and m.start() - before < 64:
                before -= 1
            if page[before] == "=" and (closing := find(m[0], start)) >= 0:
                start = closing + 1
        return done

    while at < done:
        begin = find("<", at)
        if begin < 0:
            out.append(Mark(text=page[at:]))
            break
        if begin > at:
            out.append(Mark(text=page[at:begin]))
        if page.startswith("<!--", begin):
            end = begin + 4 if page.startswith("<!-->", begin) else find("-->", begin + 4)
            at = done if end < 0 else page.index(">", end) + 1
        elif page.startswith("<![CDATA[", begin):
            end = find("]]>", begin + 9)
            out.append(Mark(text=page[begin + 9 : end if end >= 0 else done].replace("&", "&amp;")))
            at = done if end < 0 else end + 3
        elif page[begin + 1 : begin + 2] in ("!", "?"):
            end = find(">", begin)
            at = done if end < 0 else end + 1
        else:
            ending = page[begin + 1 : begin + 2] == "/"
            initial = page[begin + 1 + ending : begin + 2 + ending]
            if not (initial.isascii() and initial.isalpha()):
                out.append(Mark(text="<"))
                at = begin + 1
                continue
            name = _NAME.match(page, begin + 1 + ending)
            end = tag_end(name.end())
            rest = page[name.end() : end]
            tag, at = name[0].lower(), min(end + 1, done)
            empty = rest.endswith("/") and not _BARE.search(rest, max(0, len(rest) - 4096))
            out.append(Mark(tag, rest, ending, empty))
            if tag in RAW_TEXT and not ending and not empty:
                place = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
                at = place.start() if place else done
    return out


def match(marks: list[Mark]) -> None:
    """Set where each element ends: at its end tag, at a start tag that ends it, or with what is around it."""
    stack: list[tuple[int, dict[str, list[int]]]] = []
    held: dict[str, int] = {}
    loose: dict[str, list[int]] = {}

    def pop(place: int, closed: bool = False) -> None:
        nonlocal loose
        first, outer = stack.pop()
        held[marks[first].tag] -= 1
        marks[first].end, marks[first].closed = place, closed
        for places in loose.values():
            for p in places:
                marks[p].end = place
        loose = outer

    for i, m in enumerate(marks):
        if not m.tag or m.tag in VOID:
            m.end = i
        elif m.tag not in _FRAMES:  # elements within a line
            if not m.ending and not m.empty:
                loose.setdefault(m.tag, []).append(i)
            elif m.ending and loose.get(m.tag):
                first = loose[m.tag].pop()
                marks[first].end, marks[first].closed = i, True
            else:
                m.end = i
        elif m.ending:
            if held.get(m.tag):
                while marks[stack[-1][0]].tag != m.tag:
                    pop(i)
                pop(i, True)
        else:
            while stack and m.tag in _ENDED_BY.get(marks[stack[-1][0]].tag, ()):
                pop(i)
            m.end = i
            if not m.empty:
                stack.append((i, loose))
                loose = {}
                held[m.tag] = held.get(m.tag, 0) + 1
    while stack:
        pop(len(marks))
    for places in loose.values():
        for p in places:
            marks[p].end = len(marks)


def attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return found


def _named(labels: str) -> bool:
    """Whether a class or id is made of names of boilerplate, and of words that go beside them."""
    for label in _CAMEL.sub(r"\1-\2", labels).lower().split():
        parts = {p for p in _PARTS.split(label) if p}
        if parts & NAMES and parts <= NAMES | BESIDE:
            return True
    return False


def boilerplate(tag: str, source: str, inside: bool) -> str:
    """'' or by what an element is no part of an article: ``tag`` (or role, or being hidden) or ``name``."""
    if tag in NEVER or tag == "header" and not inside:
        return "tag"
    if not source or source.isspace() or tag in ("html", "body", "main"):
        return ""
    a = attributes(source)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return "tag"
    if a.get("role", "").lower() in ROLES:
        return "tag"
    labels = f"{a.get('class', '')} {a.get('id', '')}"
    return "name" if _named(labels) and (tag != "article" or "comment" in labels.lower()) else ""


def lines(page: str) -> list[Line]:
    """The page's lines in order."""
    marks = scan(page)
    match(marks)
    # How many marks before each place open what only a page's main part has, and where articles start.
    central, starts = [0], []
    for i, m in enumerate(marks):
        central.append(central[-1] + (not m.ending and m.tag in ("main", "h1")))
        if not m.ending and m.tag in ("article", "main"):
            starts.append(i)
    out, now, link, lead, articles, within, at = [], Line(), 0, 0, 0, [], 0
    upcoming = 0

    def close() -> None:
        nonlocal now, lead
        if any(not p.isspace() for p in now.parts):
            now.lead, lead = lead, 0
            out.append(now)
        now = Line(article=within[-1][1] if within else 0)

    while at < len(marks):
        m = marks[at]
        while within and at >= within[-1][0]:
            within.pop()
        if not m.tag:
            text = unescape(m.text)
            now.parts.append(text)
            now.article = within[-1][1] if within else 0
            if at < link:
                now.linked += len(text.strip())
            at += 1
            continue
        why = "" if m.ending else boilerplate(m.tag, m.text, bool(within))
        if why == "name" and central[m.end] > central[at + 1]:
            why = ""  # a name of the page's layout, around its main part
        if why:
            if m.tag in _FRAMES or m.tag in VOID or not within:
                close()
            if not within:
                lead += WINDOW  # its lines are silent; within an article the article goes on
            end = max(m.end, at + 1)
            if not m.closed and m.tag not in _ENDED_BY:  # never closed: an article that starts in it isn't its part
                while upcoming < len(starts) and starts[upcoming] <= at:
                    upcoming += 1
                k = upcoming
                while k < len(starts) and starts[k] < end:
                    if not boilerplate(marks[starts[k]].tag, marks[starts[k]].text, False):
                        end = starts[k]
                        break
                    k += 1
            at = end
            continue
        if m.tag == "a" and not m.ending:
            link = max(link, m.end)
        elif m.tag == "br":
            now.parts.append(" ")
        if m.tag in BLOCKS:
            close()
            link = 0
            now.heading = m.tag in HEADINGS and not m.ending
            if m.tag in ("article", "main") and not m.ending:
                if not within:
                    articles += 1
                within.append((m.end, articles))
                now.article = articles
        at += 1
    close()
    return out


def between_points(lengths: list[int], surge: float, joined: list[bool], window: int = WINDOW) -> list[tuple[int, int]]:
    """The (first, last + 1) lines between surge and dive points of a page's line lengths.

    A line that is ``joined`` and not silent goes with the next one: the surge starts at the first of them.
    """
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    kept, i, dived = [], 0, 0
    while i < len(lengths):
        if lengths[i] and sums[i] > surge:
            first, end = i, i
            while first > dived and lengths[first - 1] and joined[first - 1]:
                first -= 1
            while end < len(lengths) and sums[end]:
                end += 1
            last = end
            while last > i and not lengths[last - 1]:
                last -= 1
            kept.append((first, last))
            i = dived = max(end, i + 1)
        else:
            i += 1
    return kept


def surge_of(lengths: list[int], articles: list[int], window: int = WINDOW) -> float:
    """The threshold of a page: SURGE, or less where the largest window, or that of a marked article, is small."""
    largest: dict[int, int] = {}
    for i, n in enumerate(lengths):
        if n:
            largest[articles[i]] = max(largest.get(articles[i], 0), sum(lengths[i : i + window]))
    return min(SURGE, SURGE_SHARE * min(largest.values())) if largest else SURGE


def main_text(page: str | None) -> str:
    """The article's blocks, white space inside each turned into one space, joined by two line feeds.

    Where a page marks articles that hold text, lines outside them are silent; elsewhere lines that are
    mostly links are, but such a line between surge and dive stays. Null and empty pages give the empty
    text, as do pages without text; nothing is capped, and time grows in proportion to a page's length,
    however malformed it is.
    """
    found = [(line, line.text()) for line in lines(page or "")]
    total, held = (sum(len(t) for line, t in found if line.article or not only) for only in (False, True))
    marked = held > 0 and held >= MARKED_SHARE * total
    lengths, texts, articles, joined = [], [], [], []
    for line, text in found:
        silent = not line.article if marked else line.linked > LINK_SHARE * max(len(text), 1)
        gap = min(line.lead, WINDOW)
        lengths += [0] * gap + [0 if silent else len(text)]
        texts += [""] * gap + ["" if marked and silent else text]
        articles += [0] * gap + [line.article if marked else 0]
        joined += [False] * gap + [marked or line.heading]
    kept = between_points(lengths, surge_of(lengths, articles), joined)
    return "\n\n".join(t for a, b in kept for t in texts[a:b] if t)


def extract(html: Column) -> Column:
    """The main text of a column of pages: one value for each row, null pages and repeated ones included; none for an empty table."""

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py()).encode("utf-8", "replace").decode() for p in pages], pa.string())

    return of(html.cast("string"))
