"""HTML: text, sections, tables. One Arrow pass per document with the standard library's tokenizer; the rest are column functions."""

from __future__ import annotations

import re
from functools import reduce
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
_BLOCK = frozenset("address article aside blockquote center dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_BOLD = frozenset(("b", "strong"))
_STYLE_BOLD = re.compile(r"font-weight\s*:\s*(bold|[6-9]00)", re.I)
_STYLE_CENTER = re.compile(r"text-align\s*:\s*center", re.I)
_STYLE_UNDER = re.compile(r"text-decoration[^;]*underline", re.I)


_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))


class Style(NamedTuple):
    """What a piece of text inherits from the tags around it."""

    hidden: bool
    bold: bool
    under: bool
    centered: bool
    heading: str | None
    href: str | None
    in_title: bool


_PLAIN = Style(False, False, False, False, None, None, False)


def _cell(at: dict[str, str]) -> list:
    """Texts, columns and rows of a cell; a rowspan of 0 reaches down to the last row."""
    wide, deep = at.get("colspan", "1").strip(), at.get("rowspan", "1").strip()
    return [[], int(wide) if wide.isdigit() and 0 < int(wide) < 1000 else 1, int(deep) if deep.isdigit() and int(deep) < 65535 else 1]


class Document(HTMLParser):
    """Text pieces with their surroundings, anchors, links and tables of one document."""

    def __init__(self, exclude: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.exclude, self.stack, self.pieces = exclude | _HIDDEN, [], []
        self.anchors: dict[str, int] = {}
        self.links: list[tuple[str, str, int]] = []
        self.tables: list[dict] = []
        self.open_tables: list[dict] = []
        self.block = 0

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        for key in ("id", "name"):
            if at.get(key):
                self.anchors.setdefault(at[key], len(self.pieces))
        if tag in _BLOCK or tag == "br":
            self.block += 1
        if tag == "table":
            table = {"start": len(self.pieces), "rows": [], "header": False, "outer": len(self.open_tables)}
            self.tables.append(table)
            self.open_tables.append(table)
        elif self.open_tables:
            rows = self.open_tables[-1]["rows"]
            if tag == "tr":
                rows.append([])
            elif tag in ("td", "th"):
                if not rows:
                    rows.append([])
                rows[-1].append(_cell(at))
                self.open_tables[-1]["header"] |= tag == "th"
        if tag not in _VOID:
            self.stack.append((tag, self._under(tag, at, self.stack[-1][1] if self.stack else _PLAIN)))

    def _under(self, tag: str, at: dict[str, str], above: Style) -> Style:
        """What text inside a tag inherits."""
        style = at.get("style", "")
        return Style(
            above.hidden or tag in self.exclude, above.bold or tag in _BOLD or bool(style and _STYLE_BOLD.search(style)), above.under or tag == "u" or bool(style and _STYLE_UNDER.search(style)),
            above.centered or tag == "center" or at.get("align", "").lower() == "center" or bool(style and _STYLE_CENTER.search(style)), above.heading or (tag if tag in _HEADINGS else None),
            at["href"][1:] if tag == "a" and at.get("href", "").startswith("#") else above.href, above.in_title or tag == "title",
        )

    def handle_endtag(self, tag):
        if tag in _BLOCK:
            self.block += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        if tag == "table" and self.open_tables:
            self.open_tables.pop()["end"] = len(self.pieces)

    def handle_data(self, data):
        now = self.stack[-1][1] if self.stack else _PLAIN
        if now.hidden or not (text := " ".join(data.split())):
            return
        if now.href:
            self.links.append((now.href, text, len(self.pieces)))
        if self.open_tables and self.open_tables[-1]["rows"] and self.open_tables[-1]["rows"][-1]:
            self.open_tables[-1]["rows"][-1][-1][0].append(text)
        self.pieces.append({"text": text, "block": self.block, "bold": now.bold, "centered": now.centered, "under": now.under, "heading": now.heading, "in_table": bool(self.open_tables), "in_title": now.in_title})


def parse(html: str | None, exclude: tuple[str, ...] = ()) -> Document:
    doc = Document(frozenset(exclude))
    doc.feed(html or "")
    doc.close()
    for t in doc.tables:
        t.setdefault("end", len(doc.pieces))
    return doc


def grid(table: dict) -> list[list[str]]:
    """Rows of fields with all spans laid out: a cell's text stands in its first column, in each row that it spans; its other columns are empty.

    Cells fill the places that cells of rows above have not taken; where a cell reaches into places already taken, the earlier one keeps them.
    """
    rows, out = table["rows"], []
    taken: list[dict[int, str]] = [{} for _ in rows]
    for r, row in enumerate(rows):
        column, mine = 0, taken[r]
        for texts, wide, deep in row:
            while column in mine:
                column += 1
            text = " ".join(texts)
            for below in taken[r : len(rows) if deep == 0 else r + deep]:
                for c in range(column, column + wide):
                    below.setdefault(c, text if c == column else "")
            column += wide
        out.append([mine.get(c, "") for c in range(1 + max(mine, default=-1))])
        mine.clear()
    return out


_PLAIN_TAG = re.compile(r'<(?:/(table|tr|td|th)|(table|tr|td|th)((?:\s+[a-z]+="[^"<>&]*")*))\s*>|([^<&]+)')
_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')


def _plain_tables(page: str) -> list[dict] | None:
    """Tables of a page that holds nothing but plain table tags and text, as parse gives them; None for any other page."""
    tables, opened, at = [], [], 0
    for m in _PLAIN_TAG.finditer(page):
        if m.start() != at:
            return None
        at = m.end()
        closed, tag, attributes, text = m.groups()
        rows = opened[-1]["rows"] if opened else None
        if text is not None:
            if rows and rows[-1] and (words := " ".join(text.split())):
                rows[-1][-1][0].append(words)
        elif closed:
            if closed == "table" and opened:
                opened.pop()
        elif tag == "table":
            opened.append({"rows": []})
            tables.append(opened[-1])
        elif rows is not None:
            if tag == "tr" or not rows:
                rows.append([])
            if tag != "tr":
                rows[-1].append(_cell(dict(_ATTRIBUTE.findall(attributes))) if attributes else [[], 1, 1])
    return tables if at == len(page) else None


def page_tables(page: str | None) -> list[dict]:
    """Tables of a page with their rows; the parser reads the pages that hold more than plain tables."""
    found = _plain_tables(page or "")
    return parse(page).tables if found is None else found


def matrix(table: dict, spans: str = "none") -> list[list[str | None]]:
    """Rows of fields. spans: "none" one field a cell; "separate" repeats a spanning field as empty ones; "merge" joins fields under a spanning header. The last two carry cells down that span rows."""
    if spans == "none":
        return [[" ".join(c) for c, *_ in row] for row in table["rows"]]
    wide = grid(table)
    if spans == "separate" or not wide:
        return wide
    starts, at = [], 0
    for _, n, _ in table["rows"][0]:
        starts.append((at, at + n))
        at += n
    return [[" ".join(x for x in row[a:b] if x) for a, b in starts] + row[at:] for row in wide]


def clean_matrix(rows: list[list[str | None]]) -> list[list[str]]:
    """Fields trimmed, rows and columns without any text dropped."""
    rows = [[" ".join((x or "").split()) for x in row] for row in rows]
    rows = [r for r in rows if any(r)]
    width = max(map(len, rows), default=0)
    keep = [i for i in range(width) if any(i < len(r) and r[i] for r in rows)]
    return [[r[i] if i < len(r) else "" for i in keep] for r in rows]


_BULLET = re.compile(r"^(?:[·•●○▪■◦‣*–—-]|\(?[0-9]{1,2}[.)]|\(?[a-z][.)])$")
#: Headers that a registration table has, all of them.
_REGISTRATION = (re.compile(r"(?i)title\s*of\s*each\s*class.*regi"), re.compile(r"(?i)amount\s*(?:being|to\s*be)\s*registered|proposed\s+(?:maximum)?\s*(?:aggregate)?\s*offering\s*price"), re.compile(r"(?i)amount\s*of\s*registration\s*fee"))


def classify(rows: list[list[str]]) -> str:
    if not rows:
        return "empty"
    if len(rows) == 1:
        return "one_row_table"
    head = " ".join(" ".join(r) for r in rows[:2])
    if all(p.search(head) for p in _REGISTRATION):
        return "registration_table"
    if all(len(r) >= 2 and _BULLET.match(r[0]) for r in rows):
        return "ul_bullet_points"
    return "unclassified"


def has_header(table: dict) -> bool:
    """A header cell anywhere, or text in the first row."""
    return table["header"] or bool(table["rows"]) and any(" ".join(c).strip() for c, *_ in table["rows"][0])


def as_text(kind: str, rows: list[list[str]]) -> str | None:
    """Text that stands in for a layout table; None for data tables."""
    if kind == "ul_bullet_points":
        return "\n".join(" ".join(r) for r in rows)
    if kind == "one_row_table":
        return "\t".join(rows[0])
    return "" if kind == "empty" else None


def headers(doc: Document, reach: int = 400) -> list[tuple[int, str, bool]]:
    """(piece, text, is_main) of pieces styled as headers: headings, and bold or underlined centred lines; upper case is main.

    Header lines in consecutive blocks and within `reach` characters are one header.
    """
    out: list[list] = []
    for i, p in enumerate(doc.pieces):
        styled = p["heading"] or (p["centered"] and (p["bold"] or p["under"])) or (p["bold"] and p["text"].isupper() and len(p["text"]) > 3)
        if not styled or p["in_table"] or p["in_title"]:
            continue
        if out and out[-1][3] == i - 1 and p["block"] - doc.pieces[i - 1]["block"] <= 1 and len(out[-1][1]) + len(p["text"]) <= reach and p["text"].isupper() == out[-1][2]:
            out[-1][1] += " " + p["text"]
            out[-1][3] = i
        else:
            out.append([i, p["text"], p["text"].isupper(), i])
    return [(i, t, up) for i, t, up, _ in out]


#: Items that a table of contents has, and phrases of cover pages and notes.
_TOC = (re.compile(r"(?i)plan\s+of\s+distribution|rescission\s+offer|legal\s+matters"), re.compile(r"(?i)use\s+of\s+proceeds"))
_COVER = re.compile(r"(?i)^\s*(?:preliminary\s+)?prospectus\b|subject\s+to\s+completion")
_NOTE = re.compile(r"EXPLANATORY\s*NOTE")


def toc_tables(doc: Document, required=_TOC) -> list[dict]:
    """Tables in which every required item is found."""
    return [t for t in doc.tables if all(any(r.search(c) for row in matrix(t) for c in row) for r in required)]


def section_starts(doc: Document) -> tuple[str, list[tuple[int, str]]]:
    """(strategy, starts): by links of the contents to anchors, else by titles of the contents found as headers, else by styled headers."""
    linked = {}
    for target, text, at in doc.links:
        if target in doc.anchors and doc.anchors[target] > at and not re.fullmatch(r"[0-9ivxlc\-. ]+", text.lower()):
            linked.setdefault(doc.anchors[target], text)
    if len(linked) >= 2:
        return "toc_links", sorted(linked.items())
    tables = toc_tables(doc)
    if tables:
        titles = [next((c for c in row if c and not re.fullmatch(r"[0-9ivxlc\-. ]+", c.lower())), "") for row in clean_matrix(matrix(tables[0]))]
        from .headings import align

        after = tables[0]["end"]
        names = [(i, t) for i, t, _ in headers(doc) if i >= after] or [(i, p["text"]) for i, p in enumerate(doc.pieces) if i >= after and len(p["text"]) <= 300]
        titles = list(filter(None, titles))
        found = {names[j][0]: titles[i] for i, j, _ in align(titles, [t for _, t in names])}
        if len(found) >= 2:
            return "toc_titles", sorted(found.items())
    return "headers", [(i, t) for i, t, _ in headers(doc)]


def covers(doc: Document) -> list[int]:
    """Pieces at which a cover page starts: the last cover phrase before each table of contents."""
    out, low = [], 0
    for t in toc_tables(doc):
        hit = [i for i in range(low, t["start"]) if _COVER.search(doc.pieces[i]["text"])]
        if hit:
            out.append(hit[-1])
        low = t["end"]
    return out


def front(doc: Document, cover: int) -> dict[int, str]:
    """Starts before the first cover page: the front page, and an explanatory note if there is one."""
    out = {next((i for i, p in enumerate(doc.pieces) if not p["in_title"]), 0): "front page"} if cover else {}
    note = next((i for i in range(cover) if _NOTE.search(doc.pieces[i]["text"]) and not doc.pieces[i]["in_title"]), None)
    return out if note is None else out | {note: "explanatory note"}


def sections(html: str | None) -> list[dict]:
    """Sections in order: title, strategy, text (data tables left out, layout tables as text), tables.

    What stands before a first cover page is the front page, with an explanatory note as a section of its own; before any other first start it is "before".
    """
    doc = parse(html)
    strategy, starts = section_starts(doc)
    cover = covers(doc)
    if cover:
        starts = sorted({**front(doc, cover[0]), **dict.fromkeys(cover, "cover page"), **dict(starts)}.items())
    bounds = [(0, "before"), *starts] if not starts or starts[0][0] else starts
    out = []
    for k, (at, title) in enumerate(bounds):
        end = bounds[k + 1][0] if k + 1 < len(bounds) else len(doc.pieces)
        skip, tables, inserted = set(), [], {}
        for t in doc.tables:
            # a table without text at the very end starts where the pieces end
            if (at <= t["start"] < end or t["start"] == end == len(doc.pieces)) and not t["outer"]:
                rows = clean_matrix(matrix(t, "separate"))
                kind = classify(rows)
                text = as_text(kind, rows)
                skip |= set(range(t["start"], t["end"]))
                inserted[t["start"]] = text
                tables.append({"classification": kind, "kind": "extracted" if text is None else "reintegrated", "rows": rows})
        parts = []
        for i in range(at, end):
            if i in inserted and inserted[i]:
                parts.append(inserted[i])
            if i not in skip and not doc.pieces[i]["in_title"]:
                parts.append(doc.pieces[i]["text"])
        if title == "before" and not tables and not "".join(parts):
            continue
        out.append({"number": len(out), "title": title, "strategy": strategy, "text": " ".join(parts), "tables": tables})
    return out


_TABLE = pa.struct([("classification", pa.string()), ("kind", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])
_SECTIONS = [("number", pa.int32()), ("title", pa.string()), ("strategy", pa.string()), ("text", pa.string()), ("tables", pa.list_(_TABLE))]
SECTION_SCHEMA = "number int, title string, strategy string, text string, tables array<struct<classification string, kind string, rows array<array<string>>>>"


def split_sections(docs: DataFrame, key: str, html: str) -> DataFrame:
    """One row per section: key, number, title, strategy, text, tables. A narrow Arrow stage; a null document gives one empty section or none."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s in sections(h):
                    keys.append(k)
                    rows.append(s)
            columns = [pa.array([r[n] for r in rows], t) for n, t in _SECTIONS]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *columns], names=[key, *[n for n, _ in _SECTIONS]])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, html).mapInArrow(run, f"`{key}` {kind}, {SECTION_SCHEMA}")


def table_rows(docs: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, fields: the rows of every table of a page with spans laid out (see grid), as they stand, in one Arrow pass. A nested table is a table of its own."""

    def run(batches):
        for batch in batches:
            keys, rows = [], []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, t in enumerate(page_tables(h)):
                    for r, fields in enumerate(grid(t)):
                        keys.append(k)
                        rows.append((n, r, fields))
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.list_(pa.string())))]], names=[key, "table_no", "row_no", "fields"])

    return docs.select(key, html).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, table_no int, row_no int, fields array<string>")


def text_content(docs: DataFrame, key: str, html: str, exclude: tuple[str, ...] = ("title",)) -> DataFrame:
    """key, text: all text outside the excluded tags, pieces joined by one space."""

    def run(batches):
        for batch in batches:
            texts = [" ".join(p["text"] for p in parse(h, exclude).pieces) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return docs.select(key, html).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, text string")


def filing_numbers(sections_: DataFrame, key: str, number: str = "number", title: str = "title") -> DataFrame:
    """Adds filing_no: each cover page begins a filing, and front matter belongs to the first."""
    seen = F.sum(F.when(F.col(title) == "cover page", 1).otherwise(0)).over(W.partitionBy(key).orderBy(number))
    return sections_.withColumn("filing_no", F.greatest(seen, F.lit(1)))


def section_like(sections_: DataFrame, key: str, pattern: str, first: bool = True) -> DataFrame:
    """Sections whose title matches; per document the first, or all."""
    hit = sections_.where(F.col("title").rlike(pattern))
    return hit.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("number"))).where("_r = 1").drop("_r") if first else hit


def tables_of(tables: Column, classification: str, kind: str) -> Column:
    return F.filter(tables, lambda t: (t["classification"] == classification) & (t["kind"] == kind))


def summary(sections_: DataFrame) -> DataFrame:
    """Counts of each section: characters, tables taken out and put back."""
    n = lambda k: F.size(F.filter("tables", lambda t: t["kind"] == k))
    return sections_.withColumns({"n_chars": F.length("text"), "n_extracted": n("extracted"), "n_reintegrated": n("reintegrated")})


def row_ignorable(row: Column, pattern: str) -> Column:
    """Every field is empty or matches."""
    return F.forall(row, lambda c: (F.coalesce(c, F.lit("")) == "") | c.rlike(pattern))


def header_has(rows: Column, patterns: list[str]) -> Column:
    """The first row has a field for every pattern."""

    def field(pattern: str) -> Column:
        return F.exists(F.get(rows, F.lit(0)), lambda c: c.rlike(pattern))

    return reduce(lambda a, b: a & b, map(field, patterns), F.lit(True))


def shape_within(rows: Column, max_rows: int, max_columns: int, max_chars: int) -> Column:
    return (F.size(rows) <= max_rows) & F.forall(rows, lambda r: (F.size(r) <= max_columns) & F.forall(r, lambda c: F.length(F.coalesce(c, F.lit(""))) <= max_chars))


def shelf_capacity(rows: Column) -> Column:
    """The registered amount of a registration table: its total row, or its only data row; the aggregate price if given, else the number of shares."""
    head = F.get(rows, F.lit(0))
    column = lambda p: F.array_position(F.transform(head, lambda c: c.rlike(p)), True).cast("int")
    body = F.slice(rows, 2, 1 << 30)
    total = F.get(F.filter(body, lambda r: F.lower(F.get(r, F.lit(0))).startswith("total")), F.lit(0))
    row = F.coalesce(total, F.when(F.size(body) == 1, F.get(body, F.lit(0))))
    price, amount = column("(?i)aggregate\\s*offering.*price"), column("(?i)amount.*registered")
    field = lambda at: F.when(at > 0, F.nullif(F.regexp_replace(F.get(row, at - 1), "[^0-9.,]", ""), F.lit("")))
    return F.coalesce(field(price), F.concat(field(amount), F.lit(" shares")))
