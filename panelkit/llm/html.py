"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page, each with the marks of the elements around it.
Lines inside elements that never hold an article (scripts, styles, menus, forms, notices, adverts, reader
comments and the like) are left out. The text lengths of the others are summed over a sliding window of
lines; where the sum surges from a quiet stretch a candidate passage begins, where it falls back to nothing
it dives and ends. The passage with the most text is kept with all others that share its container, and with
the short lines of that container between them and the short paragraphs at their ends.

An outermost <article> or <main> is a weight and a border: its lines count four times and never as quiet, and
no passage crosses its edge. Longer text outside can still win. Articles side by side in one element are joined.

An element marked by its class or id as none of the article is left out too, unless it contains an article or most
of the page's text. The page's first article makes it a wrapper that counts like any other element; else its text
counts a sixteenth, when passages are compared, and is joined with no text outside.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, the share of the densest window's text that counts as a surge, and the most characters
#: that the level can come to, so that one huge block does not make ordinary paragraphs quiet.
WINDOW, SURGE, LEVEL = 3, 0.02, 30
#: What a character inside <article> or <main> counts.
TAGGED = 4
#: What the text of a marked element is divided by.
MARKED = 16

# Element names of HTML by role.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "textarea", "label", "fieldset", "iframe", "object", "svg", "math", "canvas", "audio", "video", "dialog", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
INLINE_DROP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
MARKS = re.compile(r"(?:^|\s|(?<!\bhas)(?<!\bno)(?<!\bwith)(?<!\bwithout)[_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|outbrain|popup|promo\w*|related|replies|respond|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|subscription|taboola|tags?|toolbar|widget)(?:$|[\s_-])", re.I)
START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
HOLDERS = {"html", "body", "main", "article", "div", "td", "center", "details"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}


@dataclass(eq=False)
class Holder:
    """An element that can contain an article; the elements in it are those numbered from ``enter`` to ``leave``."""

    up: Holder | None
    enter: int
    leave: float = math.inf

    def contains(self, first: int, last: int) -> bool:
        return self.enter <= first and last <= self.leave


@dataclass(eq=False)
class Mark:
    """An element whose class or id says that it is none of the article.

    ``kept`` says that it and all marked elements around it stay; ``zone`` is the innermost of them that is no wrapper of
    the page's first article.
    """

    up: Mark | None
    size: int = 0
    articles: int = 0
    first: bool = False
    kept: bool = True
    zone: Mark | None = None


def settle(marks: list[Mark], total: int) -> None:
    """Sums sizes and articles up to the elements around, which come earlier in the list, then decides from the outside in."""
    for m in reversed(marks):
        if m.up:
            m.up.size += m.size
            m.up.articles += m.articles
            m.up.first |= m.first
    for m in marks:
        m.kept = (m.articles > 0 or 2 * m.size > total) and (m.up is None or m.up.kept)
        m.zone = m if not m.first else m.up.zone if m.up else None


@dataclass
class Line:
    text: str
    dropped: bool
    root: Holder | None
    holder: Holder
    prose: bool
    mark: Mark | None

    @property
    def weight(self) -> int:
        return len(self.text) * TAGGED + LEVEL if self.root else len(self.text)

    @property
    def zone(self) -> tuple[Holder | None, Mark | None]:
        return self.root, self.mark


def _marked(name: str, attributes: str) -> bool:
    if not attributes or name in ("body", "html", "main", "article"):
        return False
    return any(key.lower() in ("class", "id") and MARKS.search(a or b or c) for key, a, b, c in ATTRIBUTE.findall(attributes))


def _unwanted(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("body", "html", "main", "article"):
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in INLINE_DROP_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or "", name, attributes) of tags; comments and the like have no name, and CDATA is "cdata" with its text.

    A quote that nothing closes is an ordinary character, so the tag ends at the next ">". What is found missing once is
    not looked for again, so a page is read once.
    """
    at, missing = 0, set()

    def find(text: str, place: int) -> int:
        if text in missing:
            return -1
        found = page.find(text, place)
        if found < 0:
            missing.add(text)
        return found

    while (found := START.search(page, at)) is not None:
        start, at = found.start(), found.end()
        if found[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(found[0], ">")
            end = find(close, at)
            text = page[at : len(page) if end < 0 else end]
            at = len(page) if end < 0 else end + len(close)
            yield start, at, "", "cdata" if close == "]]>" else "", text
            continue
        inside, end = at, -1
        while (stop := STOP.search(page, at)) is not None:
            if stop[0] == ">":
                end = stop.start()
                break
            quote = find(stop[0], stop.end())
            at = stop.end() if quote < 0 else quote + 1
        attributes = page[inside : len(page) if end < 0 else end]
        at = len(page) if end < 0 else end + 1
        name = found[2].lower()
        yield start, at, found[1], name, attributes
        if name in RAW and not found[1]:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at) if f"/{name}" not in missing else None
            if end is None:
                missing.add(f"/{name}")
            at = len(page) if end is None else end.start()


class Stack:
    """Open elements, with the places of each name, of blocks, and of blocks that are no paragraph."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.holders: list[Holder] = []
        self.hidden: list[bool] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.others: list[int] = []
        self.count = 0
        self.top = Holder(None, 0)

    def inner(self) -> Holder:
        return self.holders[-1] if self.holders else self.top

    def push(self, name: str, bad: bool) -> None:
        at, holder = len(self.names), self.inner()
        self.count += 1
        self.names.append(name)
        self.hidden.append(bad)
        self.holders.append(Holder(holder, self.count) if name in HOLDERS else holder)
        self.places.setdefault(name, []).append(at)
        if name in BLOCKS:
            self.blocks.append(at)
            if name != "p":
                self.others.append(at)

    def pop(self) -> tuple[str, bool]:
        at, name, bad, holder = len(self.names) - 1, self.names.pop(), self.hidden.pop(), self.holders.pop()
        if name in HOLDERS:
            holder.leave = self.count
        self.places[name].pop()
        for places in (self.blocks, self.others):
            if places and places[-1] == at:
                places.pop()
        return name, bad

    def closes(self, name: str) -> bool:
        """Whether an end tag of that name ends something: an open element, but no inline one around a block."""
        own = self.places.get(name)
        return bool(own) and (name in BLOCKS or not self.blocks or self.blocks[-1] < own[-1])

    def paragraph(self) -> bool:
        """Whether a paragraph is open with no other block in it."""
        own = self.places.get("p")
        return bool(own) and (not self.others or self.others[-1] < own[0])

    def around(self) -> tuple[Holder, bool]:
        """The container of the innermost open block, and whether that is a paragraph or heading."""
        at = self.blocks[-1] if self.blocks else 0
        return self.holders[at - 1] if at > 0 else self.top, bool(self.names) and self.names[at] in PROSE


def lines(page: str) -> list[Line]:
    """The blocks of a page in order; character references decoded, white space made single, empty blocks left out.

    Unclosed paragraphs and items end where the next block starts, a stray end tag is passed over, and what
    is open at the end of the page ends there.
    """
    out: list[Line] = []
    text: list[str] = []
    stack, every = Stack(), []
    marks: list[Mark | None] = [None]
    seen: set[str] = set()
    hidden = 0
    roots: list[Holder] = []
    at = 0

    def push(name: str, bad: bool, attributes: str) -> None:
        nonlocal hidden
        if name in ("article", "main") and not hidden:
            if marks[-1] and not stack.places.get("article"):
                marks[-1].articles += 1
                marks[-1].first |= name not in seen
            seen.add(name)
        if not bad and _marked(name, attributes):
            every.append(Mark(marks[-1]))
            marks.append(every[-1])
        else:
            marks.append(marks[-1])
        stack.push(name, bad)
        hidden += bad

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Line(joined, hidden > 0, roots[0] if roots else None, *stack.around(), marks[-1]))
        text.clear()

    def pop() -> str:
        nonlocal hidden
        name, bad = stack.pop()
        marks.pop()
        hidden -= bad
        if name in ("article", "main"):
            roots.pop()
        return name

    skipped = False
    for start, end, closing, name, attributes in tags(page):
        if not skipped:
            text.append(page[at:start])
        skipped, at = False, end
        if name == "cdata":
            text.append(html.escape(attributes))
            continue
        if not name:
            continue
        if name in BLOCKS or name in DROPPED or name == "br":
            if name == "br":
                text.append(" ")
            else:
                flush()
        if closing:
            if stack.closes(name):
                while pop() != name:
                    pass
            continue
        while stack.names and name in CLOSED_BY.get(stack.names[-1], ()):
            pop()
        if name in BLOCKS:
            while stack.paragraph():
                pop()
        if name in VOID or attributes.rstrip().endswith("/") and name in ("svg", "path"):
            continue
        push(name, _unwanted(name, attributes), attributes)
        skipped = name in RAW
        if name in ("article", "main"):
            roots.append(stack.inner())
    if not skipped:
        text.append(page[at:])
    flush()
    shown = [r for r in out if not r.dropped]
    for r in shown:
        if r.mark:
            r.mark.size += len(r.text)
    settle(every, sum(len(r.text) for r in shown))
    for r in shown:
        if r.mark:
            r.dropped = not r.mark.kept
            r.mark = r.mark.zone
    return out


def surge_level(sums: list[int]) -> float:
    return min(LEVEL, SURGE * max(sums, default=0))


def passages(rows: list[Line]) -> tuple[list[tuple[int, int]], float]:
    """(surge, dive) of every stretch in which the text of a window of lines stays above the surge level; the level.

    A stretch also ends at the edge of an outermost article or a marked element.
    """
    sizes = [r.weight for r in rows]
    half = WINDOW // 2
    sums = [sum(sizes[max(0, i - half) : i + half + 1]) for i in range(len(rows))]
    level = surge_level(sums)
    found, start = [], None
    for i, s in enumerate([*sums, 0]):
        if start is not None and i < len(rows) and rows[i].zone != rows[i - 1].zone:
            found.append((start, i))
            start = None
        if s > level and start is None:
            start = i
        elif s <= level and start is not None:
            found.append((start, i))
            start = None
    return found, level


def shared_holder(holders: list[Holder]) -> Holder:
    """The innermost container of all."""
    first, last = min(h.enter for h in holders), max(h.enter for h in holders)
    at = holders[0]
    while not at.contains(first, last):
        at = at.up
    return at


def main_text(page: str | None) -> str:
    """The text between surge and dive points of the densest passage and its like; empty for a page without text."""
    rows = [r for r in lines(page or "") if not r.dropped]
    spans, level = passages(rows)
    if not spans:
        return ""
    size = lambda a, b: sum(r.weight for r in rows[a:b])
    a, b = max(spans, key=lambda s: size(*s) / (MARKED if rows[s[0]].mark else 1))
    root, mark = rows[a].zone
    if root:
        kept = [r for x, y in spans for r in rows[x:y] if r.root and r.root.up is root.up and r.mark is mark]
    else:
        core = [r.holder for r in rows[a:b] if r.weight > level] or [r.holder for r in rows[a:b]]
        shared = shared_holder(core)
        within = [r.zone == (root, mark) and shared.contains(r.holder.enter, r.holder.enter) for r in rows]
        joined = [(x, y) for x, y in spans if (x, y) == (a, b) or 2 * sum(rows[i].weight for i in range(x, y) if within[i]) > size(x, y)]
        inside = {i for x, y in joined for i in range(x, y)}
        first, last = min(x for x, _ in joined), max(y for _, y in joined)
        while first > 0 and rows[first - 1].prose and within[first - 1]:
            first -= 1
        while last < len(rows) and rows[last].prose and within[last]:
            last += 1
        kept = [rows[i] for i in range(first, last) if i in inside or within[i]]
    return "\n".join(r.text for r in kept)


def with_main_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Adds the main text of each whole page; null pages give an empty text. Row-wise; other columns are left alone."""

    @F.pandas_udf("string")
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) for x in col], dtype=object)

    return pages.withColumn(out_col, run(F.col(html_col).cast("string")))
