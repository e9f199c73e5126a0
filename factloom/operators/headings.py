"""Headings of a page by style, and titles of a contents list aligned with them.

Styles are selectors compiled into one automaton over the stack of open tags: a state is how far a selector has come, a tag's states follow from those of its parent
(`>`) or of anything above it (a space), and all selectors advance at once as bits of an integer.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .html import _HIDDEN, _VOID

_CENTER = r"text-align:\s?center"
_WEIGHT = r"font-weight:\s?(?:bold|700)"
_FONT = r"font:\s?bold"
#: The groups of heading styles in order. A step is (joined to the step before by, tag, pattern of the style, value of align).
GROUPS: dict[str, tuple[tuple[str, str | None, str | None, str | None], ...]] = {
    "center_b": ((" ", None, None, "center"), (" ", "b", None, None)),
    "textcenter_strong": ((" ", None, _CENTER, None), (">", "strong", None, None)),
    "textcenter_b": ((" ", None, _CENTER, None), (" ", "b", None, None)),
    "textcenter_weight": ((" ", None, _CENTER, None), (">", None, _WEIGHT, None)),
    "td_textcenter_font_b": ((" ", "td", _CENTER, None), (">", "font", None, None), (">", "b", None, None)),
    "td_textcenter_font_weight": ((" ", "td", _CENTER, None), (">", "font", _WEIGHT, None)),
    "b_u": ((" ", "b", None, None), (">", "u", None, None)),
    "font_bold_text_align_center_parent": ((" ", None, f"(?=.*{_CENTER}).*{_FONT}", None), (" ", "font", None, None)),
}
#: Characters between headings that are lines of one.
REACH = 400


class Matcher:
    """All selectors at once: bits of (reached at this tag, reached at it or above)."""

    def __init__(self, groups: dict[str, Sequence[tuple]] = GROUPS):
        self.tests: list[tuple[str | None, re.Pattern | None, str | None]] = []
        self.first = self.below = self.child = 0
        self.last: list[tuple[int, str]] = []
        for name, steps in groups.items():
            for k, (joint, tag, style, align) in enumerate(steps):
                bit = 1 << len(self.tests)
                self.tests.append((tag, re.compile(style, re.I | re.S) if style else None, align))
                if k == 0:
                    self.first |= bit
                elif joint == ">":
                    self.child |= bit
                else:
                    self.below |= bit
            self.last.append((bit, name))

    def push(self, above: tuple[int, int], tag: str, attrs: dict[str, str]) -> tuple[int, int]:
        at, ever = above
        may = self.first | ((at << 1) & self.child) | ((ever << 1) & self.below)
        style, align, here, k = attrs.get("style", ""), attrs.get("align", "").lower(), 0, 0
        while may >> k:
            if may >> k & 1:
                want, pattern, side = self.tests[k]
                if (want is None or want == tag) and (pattern is None or pattern.search(style)) and (side is None or side == align):
                    here |= 1 << k
            k += 1
        return here, ever | here

    def group(self, state: tuple[int, int]) -> str | None:
        """The first group whose selector ends at the tag."""
        return next((name for bit, name in self.last if state[0] & bit), None)


class Heading(NamedTuple):
    group: str
    main: bool
    start: int
    end: int
    text: str
    lines: int


class _Page(HTMLParser):
    """Elements that a selector picks: (group, start, end, text), with places in the source; of nested ones the outer."""

    def __init__(self, source: str, matcher: Matcher):
        super().__init__(convert_charrefs=True)
        self.matcher, self.found, self.stack, self.picked = matcher, [], [], []
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.size = len(source)
        self.feed(source)
        self.close()
        while self.stack:
            self._pop(self.size)

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        state = self.matcher.push(self.stack[-1][1] if self.stack else (0, 0), tag, {k: v or "" for k, v in attrs})
        group = None if self.picked or any(t in _HIDDEN for t, *_ in self.stack) else self.matcher.group(state)
        self.stack.append((tag, state, group))
        if group:
            self.picked = [group, self._place(), []]

    def _pop(self, end: int) -> None:
        _, _, group = self.stack.pop()
        if group:
            name, start, parts = self.picked
            self.picked = []
            if text := " ".join(" ".join(parts).split()):
                self.found.append((name, start, end, text))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None:
            here = self._place()
            while len(self.stack) > at + 1:
                self._pop(here)
            self._pop(here + len(tag) + 3)

    def handle_data(self, data):
        if self.picked and not any(t in _HIDDEN for t, *_ in self.stack):
            self.picked[2].append(data)


def is_main(text: str) -> bool:
    """Upper case, or an upper case first word."""
    return (text.split() or [""])[0].isupper()


def headings(source: str | None, groups: dict[str, Sequence[tuple]] = GROUPS, reach: int = REACH) -> list[Heading]:
    """Headings in text order. Main headings of one group within `reach` characters, with no other heading between, are lines of one."""
    out: list[Heading] = []
    for group, start, end, text in _Page(source or "", Matcher(groups)).found:
        last = out[-1] if out else None
        if last and last.main and last.group == group and is_main(text) and start - last.end <= reach:
            out[-1] = last._replace(end=end, text=f"{last.text} {text}", lines=last.lines + 1)
        else:
            out.append(Heading(group, is_main(text), start, end, text, 1))
    return out


_HEADING = [("number", pa.int32()), ("group", pa.string()), ("main", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("lines", pa.int32()), ("under", pa.int32())]


def styled_headings(docs: DataFrame, key: str, html: str, groups: dict[str, Sequence[tuple]] = GROUPS, reach: int = REACH) -> DataFrame:
    """key, number, group, main, start, end, text, lines, under: headings by style with their places in the source; under is the number of the main heading that a heading belongs to, null before the first.

    One Arrow pass; null and empty pages have none.
    """

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                under = None
                for n, h in enumerate(headings(source, groups, reach)):
                    under = n if h.main else under
                    keys.append(k)
                    rows.append((n, *h, under))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_HEADING)]], names=[key, *[n for n, _ in _HEADING]])

    schema = "number int, `group` string, main boolean, start int, `end` int, text string, lines int, under int"
    return docs.select(key, html).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {schema}")


# ---- titles of contents and headings


def shape(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def edits(a: Sequence, b: Sequence, band: int, swap=lambda x, y: 1.0) -> float:
    """Edit distance within a band around the diagonal, infinite beyond it; swap prices a replaced element."""
    far = float("inf")
    if abs(len(a) - len(b)) > band:
        return far
    row = {j: float(j) for j in range(min(len(b), band) + 1)}
    for i, x in enumerate(a, 1):
        after: dict[int, float] = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, after.get(j - 1, far) + 1, row.get(j - 1, far) + (0.0 if x == b[j - 1] else swap(x, b[j - 1])))
            after[j] = best
        row = after
    return row.get(len(b), far)


def _word(a: str, b: str) -> float:
    """The price of reading one word for another: their edits by length, or 1 beyond a third."""
    most = max(len(a), len(b))
    ratio = edits(a, b, most // 3 or 1) / most
    return ratio if ratio <= 1 / 3 else 1.0


def title_cost(title: Sequence[str], heading: Sequence[str]) -> float:
    """What it costs to read a heading for a title: edits of words by the title's length; 0.3 where the heading begins with the title's first four words and is at most twice as long."""
    if not title or not heading:
        return float("inf")
    cost = edits(title, heading, 1 + len(title) // 3, _word) / len(title)
    if len(title) >= 4 and heading[:4] == title[:4] and len(heading) <= 2 * len(title):
        cost = min(cost, 0.3)
    return cost


def align(titles: Sequence[str], found: Sequence[str], most: float = 0.34, join: int = 3) -> list[tuple[int, int, int]]:
    """(title, first heading, number of headings): titles matched with headings in order, at the least total cost, a title left out costing 1.

    A match reads up to `join` headings in a row as one and may cost up to `most`. Of equally good ones the earliest headings are taken.
    """
    t = [shape(x) for x in titles]
    h = [shape(x) for x in found]
    n, m = len(t), len(h)
    words = [set(x) for x in t]
    best = [[0.0] * (m + 1) for _ in range(n)] + [[0.0] * (m + 1)]
    pick: dict[tuple[int, int], int] = {}
    for i in range(n - 1, -1, -1):
        longest = 2 * len(t[i]) + 2
        for j in range(m, -1, -1):
            cost = 1 + best[i + 1][j]
            if j < m:
                if best[i][j + 1] < cost:
                    cost = best[i][j + 1]
                run: list[str] = []
                for k in range(1, min(join, m - j) + 1):
                    run = run + h[j + k - 1]
                    if len(run) > longest or not h[j]:
                        break
                    if not h[j + k - 1]:
                        continue
                    if len(t[i]) > 1 and not words[i].intersection(run):
                        continue
                    own = title_cost(t[i], run)
                    # at equal cost a match here stands before one further on
                    if own <= most and own + best[i + 1][j + k] <= cost and (own + best[i + 1][j + k] < cost or (i, j) not in pick):
                        cost = own + best[i + 1][j + k]
                        pick[i, j] = k
            best[i][j] = cost
    out, i, j = [], 0, 0
    while i < n and j <= m:
        if (k := pick.get((i, j))) is not None:
            out.append((i, j, k))
            i, j = i + 1, j + k
        elif j < m and best[i][j + 1] <= best[i][j]:
            j += 1
        else:
            i += 1
    return out


def aligned_titles(rows: DataFrame, key: str, titles: str, found: str) -> DataFrame:
    """key, title_no, heading_no, joined: align() of two array columns of each row, in one Arrow pass. Null arrays align nothing; null texts read as empty."""

    def run(batches):
        for batch in batches:
            out = [(k, *a) for k, t, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for a in align([x or "" for x in t or ()], [x or "" for x in h or ()])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], batch.column(0).type), *[pa.array([r[i] for r in out], pa.int32()) for i in (1, 2, 3)]], names=[key, "title_no", "heading_no", "joined"])

    return rows.select(key, titles, found).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, title_no int, heading_no int, joined int")

