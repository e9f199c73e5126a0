"""Tables of PDF pages: text positions from content streams, then cuts along empty bands of the page.

Reads what text pages need: indirect objects and object streams, deflated streams, the text operators, fonts with widths, and ToUnicode maps. Encrypted files and
scanned pages give no text.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_HEAD = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = rb"(\d+)\s+\d+\s+R"
_REFS = re.compile(_REF)
_PAGES, _PAGE, _OWNED = re.compile(rb"/Type\s*/Pages\b"), re.compile(rb"/Type\s*/Page\b"), re.compile(rb"/Parent\b")
_CONTENTS, _CONTENT = re.compile(rb"/Contents\s*\["), re.compile(rb"/Contents\s+" + _REF)
_FONTS, _NAMED = re.compile(rb"/Font\s*<<(.*?)>>", re.S), re.compile(rb"/([^\s/<>]+)\s+" + _REF)
_TOKEN = re.compile(rb"<([0-9A-Fa-f\s]*)>|([\[\]])|/([^\s<>\[\]()/%]*)|([-+]?(?:\d+\.?\d*|\.\d+))(?![^\s<>\[\]()/%])|([^\s<>\[\]()/%]+)|(\()|(<<|>>)|(%[^\r\n]*)")
_NUMBER = rb"([-+]?(?:\d+\.?\d*|\.\d+))\s+"
_PLACED = re.compile(rb"\s*(1 0 0 1 |(?:[-+]?(?:\d+\.?\d*|\.\d+)\s+){4})" + 2 * _NUMBER + rb"Tm\s*\(([^()\\]*)\)\s*Tj(?![^\s<>\[\]()/%])")
_OPENING = re.compile(rb"\s*BT\s+/([^\s<>\[\]()/%]*)\s+((?:\d+\.?\d*|\.\d+))\s+Tf(?=\s)")
_PLAIN_STRING = re.compile(rb"([^()\\]*)\)")
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}


class Run(NamedTuple):
    """Text at a place: its left and right end, its baseline and its size."""

    left: float
    right: float
    base: float
    size: float
    text: str


_LEFT, _BASE = itemgetter(0), itemgetter(2)


class Font:
    def __init__(self, body: bytes, file: PdfFile):
        first = re.search(rb"/FirstChar\s+(\d+)", body)
        widths = file.array(body, b"Widths")
        self.first = int(first[1]) if first else 0
        self.widths = [float(w) for w in re.findall(rb"[-\d.]+", widths)] if widths else []
        self.wide = b"/Type0" in body
        # the widths of all codes of one byte
        self.steps = [self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else 500 for c in range(256)]
        self.known: dict[bytes, tuple[str, float, int]] = {}
        self.map: dict[int, str] = {}
        if to := re.search(rb"/ToUnicode\s+" + _REF, body):
            text = file.stream(int(to[1]))
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", text, re.S):
                for code, out in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    self.map[int(code, 16)] = bytes.fromhex(out.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", text, re.S):
                for low, high, out in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    for k in range(min(int(high, 16) - int(low, 16) + 1, 65536)):
                        self.map[int(low, 16) + k] = chr(int(out, 16) + k)

    def decode(self, data: bytes) -> tuple[str, float, int]:
        """(text, width in thousandths of the size, characters). Short strings come again and again: those of late are kept."""
        if (found := self.known.get(data)) is None:
            found = self._decode(data)
            if len(data) <= 24:
                if len(self.known) >= 8192:
                    self.known.clear()
                self.known[data] = found
        return found

    def _decode(self, data: bytes) -> tuple[str, float, int]:
        if not self.wide and not self.map:
            return data.decode("cp1252", "replace"), sum(map(self.steps.__getitem__, data)), len(data)
        codes = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)] if self.wide else list(data)
        text = "".join(self.map.get(c) or ("" if self.wide else bytes([c]).decode("cp1252", "replace")) for c in codes)
        width = sum(self.widths[c - self.first] if 0 <= c - self.first < len(self.widths) else 500 for c in codes)
        return text, width, len(codes)


@lru_cache(64)
def _font(body: bytes) -> Font | None:
    """A font that refers to no other object, the same in every file; None for others."""
    return None if _REFS.search(body) else Font(body, PdfFile(b""))


@lru_cache(64)
def _arrays(name: bytes) -> tuple[re.Pattern, re.Pattern]:
    return re.compile(rb"/%s\s*\[(.*?)\]" % name, re.S), re.compile(rb"/%s\s+%s" % (name, _REF))


@lru_cache(64)
def _matrix(numbers: bytes) -> tuple[float, float, float, float, float]:
    """The first four numbers of a text matrix and the height that it gives a size of one."""
    a, b, c, d = map(float, numbers.split())
    return a, b, c, d, (c**2 + d**2) ** 0.5


def _objects(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and body of each object; the first endobj that begins a word ends it."""
    at = 0
    while head := _HEAD.search(data, at):
        end = data.find(b"endobj", head.end())
        while end > 0 and (data[end - 1 : end].isalnum() or data[end - 1] == 95):
            end = data.find(b"endobj", end + 1)
        if end < 0:
            return
        yield int(head[1]), data[head.end() : end]
        at = end + 6


class PdfFile:
    def __init__(self, data: bytes):
        self.bodies = dict(_objects(data))
        for body in list(self.bodies.values()):
            if b"/ObjStm" in body and re.search(rb"/Type\s*/ObjStm", body):
                count, first = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"N", b"First"))
                inner = self._data(body)
                heads = [int(x) for x in inner[:first].split()[: 2 * count]]
                places = [*heads[1::2], len(inner) - first]
                for number, lo, hi in zip(heads[::2], places, places[1:], strict=False):
                    self.bodies.setdefault(number, inner[first + lo : first + hi])
        self.fonts: dict[int, Font] = {}

    @staticmethod
    def _data(body: bytes) -> bytes:
        found = _STREAM.search(body)
        end = body.find(b"endstream", found.end()) if found else -1
        if end < 0:
            return b""
        data = body[found.end() : end]
        data = data[:-2] if data.endswith(b"\r\n") else data[:-1] if data.endswith((b"\r", b"\n")) else data
        if b"/FlateDecode" in body[: found.start()]:
            try:
                data = zlib.decompressobj().decompress(data)
            except zlib.error:
                return b""
        return data

    def stream(self, number: int) -> bytes:
        return self._data(self.bodies.get(number, b""))

    def array(self, body: bytes, name: bytes) -> bytes | None:
        """The text of an array that stands in place or is referred to."""
        placed, referred = _arrays(name)
        if found := placed.search(body):
            return found[1]
        found = referred.search(body)
        return self.bodies.get(int(found[1]), b"").strip().strip(b"[]") if found else None

    def pages(self) -> list[bytes]:
        """Page objects in order: along the tree of kids where there is one."""
        root = next((n for n, b in self.bodies.items() if b"/Pages" in b and _PAGES.search(b) and not _OWNED.search(b)), None)
        out, seen, todo = [], set(), [root] if root is not None else [n for n, b in sorted(self.bodies.items()) if _PAGE.search(b)]
        while todo:
            n = todo.pop(0)
            if n in seen:
                continue
            seen.add(n)
            body = self.bodies.get(n, b"")
            if b"/Pages" in body and _PAGES.search(body):
                todo[:0] = [int(k) for k in _REFS.findall(self.array(body, b"Kids") or b"")]
            elif body:
                out.append(body)
        return out

    def _fonts_of(self, page: bytes) -> dict[str, Font]:
        body, depth = page, 0
        while b"/Font" not in body and depth < 9:
            up = re.search(rb"/Resources\s+" + _REF, body) or re.search(rb"/Parent\s+" + _REF, body)
            if not up:
                return {}
            body, depth = self.bodies.get(int(up[1]), b""), depth + 1
        found = _FONTS.search(body)
        if not found and (ref := re.search(rb"/Font\s+" + _REF, body)):
            found = re.search(rb"<<(.*)>>", self.bodies.get(int(ref[1]), b""), re.S)
        out = {}
        for name, number in _NAMED.findall(found[1]) if found else ():
            if int(number) not in self.fonts:
                body = self.bodies.get(int(number), b"")
                self.fonts[int(number)] = _font(body) or Font(body, self)
            out[name.decode("latin-1")] = self.fonts[int(number)]
        return out

    def runs(self, page: bytes) -> list[Run]:
        refs = self.array(page, b"Contents") if _CONTENTS.search(page) else None
        numbers = [int(n) for n in _REFS.findall(refs)] if refs is not None else [int(m[1]) for m in [_CONTENT.search(page)] if m]
        data, fonts = b"\n".join([self.stream(n) for n in numbers]), self._fonts_of(page)
        plain = _show_plain(data, fonts)
        return list(_show(data, fonts)) if plain is None else plain


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its opening parenthesis, and the place after its end."""
    if plain := _PLAIN_STRING.match(data, at):
        return plain[1], plain.end()
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            nxt = data[at + 1 : at + 2]
            if octal := re.match(rb"[0-7]{1,3}", data[at + 1 : at + 4]):
                out.append(int(octal[0], 8) & 255)
                at += 1 + len(octal[0])
                continue
            out += _ESCAPE.get(nxt, nxt)
            at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if depth == 0:
            break
        out += c
    return bytes(out), at


def _tokens(data: bytes) -> Iterator[tuple[str, object]]:
    at, inside = 0, False
    while True:
        # most text is a string at a stated place, read in one search
        if not inside and (placed := _PLACED.match(data, at)):
            at = placed.end()
            yield "placed", placed.groups()
            continue
        if not (found := _TOKEN.search(data, at)):
            return
        at = found.end()
        if found[6]:
            text, at = _string(data, at)
            yield "string", text
        elif found[1] is not None:
            digits = re.sub(rb"\s", b"", found[1]).decode()
            yield "string", bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif found[2]:
            inside = found[2] == b"["
            yield "bracket", found[2]
        elif found[3] is not None:
            yield "name", found[3].decode("latin-1")
        elif found[4]:
            yield "number", float(found[4])
        elif found[5]:
            yield "operator", found[5].decode("latin-1")


def _times(a, b):
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


def _show(data: bytes, fonts: dict[str, Font]) -> Iterator[Run]:
    """The runs of text that a content stream shows."""
    plain = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    page, saved, line, text = plain, [], plain, plain
    font, size, lead, gap, word = None, 1.0, 0.0, 0.0, 0.0
    args: list = []
    items: list | None = None
    for kind, value in _tokens(data):
        if kind == "bracket":
            if value == b"[":
                items = []
            elif items is not None:
                args.append(items)
                items = None
            continue
        if kind == "placed":
            (a, b, c, d, high), left, base, part = _matrix(value[0]), float(value[1]), float(value[2]), value[3]
            line = text = (a, b, c, d, left, base)
            if page is plain:
                # as Tj below, with nothing between the text and the page
                args = []
                try:
                    shown, width, n = font.decode(part) if font else (part.decode("cp1252", "replace"), 500.0 * len(part), len(part))
                    step = width / 1000 * size + n * gap + (part.count(b" ") * word if word else 0.0)
                    right = step * a + left
                    text = (a, b, c, d, right, step * b + base)
                    if shown.strip():
                        yield Run(left, right, base, abs(size) * high, shown)
                except TypeError:
                    pass  # a malformed size or distance
                continue
            args, value = [part], "Tj"
        elif kind != "operator":
            (args if items is None else items).append(value)
            continue
        try:
            if value == "q":
                saved.append(page)
            elif value == "Q":
                page = saved.pop() if saved else page
            elif value == "cm":
                page = _times(tuple(args[-6:]), page)
            elif value == "BT":
                line = text = plain
            elif value == "Tf":
                font, size = fonts.get(args[-2]), args[-1]
            elif value == "TL":
                lead = args[-1]
            elif value == "Tc":
                gap = args[-1]
            elif value == "Tw":
                word = args[-1]
            elif value in ("Td", "TD"):
                lead = -args[-1] if value == "TD" else lead
                line = text = _times((1, 0, 0, 1, args[-2], args[-1]), line)
            elif value == "Tm":
                line = text = tuple(args[-6:])
            elif value in ("T*", "'", '"'):
                line = text = _times((1, 0, 0, 1, 0, -lead), line)
                if value == '"':
                    word, gap = args[-3], args[-2]
            if value in ("Tj", "TJ", "'", '"'):
                for part in args[-1] if value == "TJ" else [args[-1]]:
                    if isinstance(part, float):
                        text = _times((1, 0, 0, 1, -part / 1000 * size, 0), text)
                        continue
                    shown, width, n = font.decode(part) if font else (part.decode("cp1252", "replace"), 500.0 * len(part), len(part))
                    step = width / 1000 * size + n * gap + part.count(b" ") * word
                    here = _times(text, page)
                    text = _times((1, 0, 0, 1, step, 0), text)
                    there = _times(text, page)
                    if shown.strip():
                        yield Run(here[4], there[4], here[5], abs(size) * (here[2] ** 2 + here[3] ** 2) ** 0.5, shown)
        except (IndexError, TypeError, ValueError):
            pass  # a malformed operator shows nothing
        args = []


def _show_plain(data: bytes, fonts: dict[str, Font]) -> list[Run] | None:
    """The runs of a page that sets one font and then shows nothing but strings at stated places; None for other pages."""
    opening = _OPENING.match(data)
    font = fonts.get(opening[1].decode("latin-1")) if opening else None
    if font is None:
        return None
    out, size, at = [], float(opening[2]), opening.end()
    placed, decode, matrix = _PLACED.match, font.decode, _matrix
    while found := placed(data, at):
        numbers, left, base, part = found.groups()
        a, _, _, _, high = matrix(numbers)
        left, (shown, width, _) = float(left), decode(part)
        if shown.strip():
            out.append(Run(left, width / 1000 * size * a + left, float(base), size * high, shown))
        at = found.end()
    return out if data[at:].strip() == b"ET" else None


def lines(runs: list[Run]) -> list[list[Run]]:
    """Runs by baseline from the top, each from the left; runs that touch are one, with a space where they stand apart a little."""
    out: list[list[Run]] = []
    head = size = 0.0
    for r in sorted(sorted(runs, key=_LEFT), key=_BASE, reverse=True):
        if out and head - r[2] <= 0.3 * max(r[3], size):
            out[-1].append(r)
        else:
            out.append([r])
            _, _, head, size, _ = r
    for k, row in enumerate(out):
        joined: list[Run] = []
        for r in sorted(row):
            if joined and (space := r[0] - joined[-1][1]) < 0.6 * r[3]:
                last = joined[-1]
                joined[-1] = last._replace(right=max(last.right, r.right), text=last.text + (" " if space > 0.15 * r.size and not last.text.endswith(" ") else "") + r.text)
            else:
                joined.append(r)
        out[k] = joined
    return out


def bands(spans: list[tuple[float, float]], least: float) -> list[float]:
    """Middles of the empty bands at least that wide between spans."""
    out, end = [], None
    for a, b in sorted(spans):
        if end is not None and a - end >= least:
            out.append((a + end) / 2)
        end = b if end is None else max(end, b)
    return out


def cut(rows: list[list[Run]], apart: float = 1.9) -> Iterator[list[list[Run]]]:
    """Blocks of lines: a page is cut where lines stand further apart than `apart` line distances, and each part again, until nothing parts."""
    if not rows:
        return
    steps = [a[0].base - b[0].base for a, b in zip(rows, rows[1:], strict=False)]
    if steps:
        # a lone distance says nothing: lines stand at most one and a half sizes apart
        usual = min(sorted(steps)[(len(steps) - 1) // 2], 1.5 * rows[0][0].size)
        at = max(range(len(steps)), key=steps.__getitem__)
        if steps[at] > apart * max(usual, max(r.size for r in rows[at])):
            yield from cut(rows[: at + 1], apart)
            yield from cut(rows[at + 1 :], apart)
            return
    yield rows


def tables(runs: list[Run]) -> Iterator[list[list[str]]]:
    """Tables of a page: blocks of two lines or more that an empty band parts into columns."""
    for block in cut(lines(runs)):
        if len(block) < 2:
            continue
        size = max([r[3] for row in block for r in row])
        edges = bands([r[:2] for row in block for r in row], 0.6 * size)
        if not edges:
            continue
        yield [_fields(row, edges) for row in block]


def _fields(row: list[Run], edges: list[float]) -> list[str]:
    fields = [""] * (len(edges) + 1)
    for left, right, _, _, text in row:
        at, text = bisect_left(edges, (left + right) / 2), text.strip()
        fields[at] = f"{fields[at]} {text}" if fields[at] else text
    return fields


def drop_columns(rows: list[list[str]]) -> list[list[str]]:
    """Of five columns the second goes, then of four the last."""
    if rows and len(rows[0]) == 5:
        rows = [[r[0], *r[2:]] for r in rows]
    return [r[:-1] for r in rows] if rows and len(rows[0]) == 4 else rows


PDF_SCHEMA = "page int, table_no int, row_no int, fields array<string>"


def table_rows(files: DataFrame, key: str, content: str, drop: bool = True) -> DataFrame:
    """key, page, table_no, row_no, fields: rows of the tables of PDF files (binary column), pages from 1, in one Arrow pass. drop applies drop_columns. Null or broken files have no rows."""

    def run(batches):
        for batch in batches:
            # a number for each row, all fields in a row, and where each row's fields end
            keys, pages, numbers, places, flat, ends = [], [], [], [], [], [0]

            def done():
                fields = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
                return pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *[pa.array(c, pa.int32()) for c in (pages, numbers, places)], fields], names=[key, "page", "table_no", "row_no", "fields"])

            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file = PdfFile(data.as_py() or b"")
                for page, body in enumerate(file.pages(), 1):
                    for n, found in enumerate(tables(file.runs(body))):
                        for r, fields in enumerate(drop_columns(found) if drop else found):
                            keys.append(k)
                            pages.append(page)
                            numbers.append(n)
                            places.append(r)
                            flat += fields
                            ends.append(len(flat))
                if len(keys) > 10_000:
                    yield done()
                    keys, pages, numbers, places, flat, ends = [], [], [], [], [], [0]
            yield done()

    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, {PDF_SCHEMA}")


def read_pdf_tables(spark: SparkSession, path: str, drop: bool = True) -> DataFrame:
    """path, page, table_no, row_no, fields of the PDF files that a path or pattern names."""
    return table_rows(spark.read.format("binaryFile").load(path), "path", "content", drop)
