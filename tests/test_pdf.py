import random
import sys

from factloom.plans.texts import _pdf
from factloom.sources import pdf


def place(rows, top, lefts=(50.0, 150.0, 230.0, 310.0, 390.0)):
    return [(x, top - 12.0 * n, t) for n, row in enumerate(rows) for x, t in zip(lefts, row, strict=False) if t]


def read(data, drop=False):
    file = pdf.PdfFile(data)
    return [[t for t in (pdf.drop_columns(t) if drop else t for t in pdf.tables(file.runs(p)))] for p in file.pages()]


def test_tables_come_back_cell_by_cell():
    rnd = random.Random(14)
    word = lambda: rnd.choice(["ACME CORP", "COM", "(A) x\\y", "17", "é£", "1,000.5", "a b c"])
    for _ in range(60):
        pages = []
        for _ in range(rnd.randrange(1, 3)):
            pages.append([[[word() for _ in range(rnd.randrange(2, 6))]] for _ in range(rnd.randrange(1, 3))])
        want, drawn = [], []
        for tables in pages:
            top, shown, own = 760.0, [(50.0, 790.0, "A heading over the page (no table)")], []
            for first in tables:
                width = len(first[0])
                rows = first + [[word() for _ in range(width)] for _ in range(rnd.randrange(1, 5))]
                for r in rows[1:]:
                    if width > 2 and rnd.random() < 0.3:
                        r[rnd.randrange(1, width)] = ""
                shown += place(rows, top)
                top -= 12.0 * len(rows) + 40
                own.append([r for r in rows])
            rnd.shuffle(shown)
            want.append(own)
            drawn.append(shown)
        assert read(_pdf(drawn)) == want


def test_columns_dropped_by_the_rule():
    assert read(_pdf([place([["a", "b", "c", "d", "e"], ["1", "2", "3", "4", "5"]], 700)]), drop=True) == [[[["a", "c", "d"], ["1", "3", "4"]]]]
    assert pdf.drop_columns([["a", "b", "c", "d"]]) == [["a", "b", "c"]] and pdf.drop_columns([["a", "b"]]) == [["a", "b"]] and pdf.drop_columns([]) == []


def test_text_operators():
    body = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 12 TL 100 200 Td [(AB) -200 (C\\051)] TJ T* (down) Tj <4869> ' 0 0 (q\\(\\)) \" ET Q BT /F1 10 Tf 5 5 Td (out) Tj ET"
    data = b"1 0 obj << /Type /Pages /Kids [2 0 R] >> endobj 2 0 obj << /Type /Page /Parent 1 0 R /Contents [3 0 R] >> endobj 3 0 obj << /Length 9 >> stream\n" + body + b"\nendstream endobj"
    file = pdf.PdfFile(data)
    runs = file.runs(file.pages()[0])
    assert [(r.text, round(r.left), round(r.base)) for r in runs] == [("AB", 210, 420), ("C)", 234, 420), ("down", 210, 396), ("Hi", 210, 372), ("q()", 210, 348), ("out", 5, 5)]
    assert [r.size for r in runs][0] == 20


def test_unicode_maps_and_object_streams():
    import zlib

    cmap = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0004> <0062> endbfrange"
    inner = b"<< /Type /Page /Parent 1 0 R /Resources << /Font << /F9 6 0 R >> >> /Contents 4 0 R >>"
    packed = zlib.compress(b"2 0 " + inner)
    data = b"".join([
        b"1 0 obj << /Type /Pages /Kids [2 0 R] >> endobj ", b"4 0 obj << >> stream\nBT /F9 8 Tf 1 1 Td <000100020004> Tj ET\nendstream endobj ", b"5 0 obj << /Filter /FlateDecode >> stream\n" + zlib.compress(cmap) + b"\nendstream endobj ",
        b"6 0 obj << /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >> endobj ", b"7 0 obj << /Type /ObjStm /N 1 /First 4 /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj",
    ])
    file = pdf.PdfFile(data)
    assert [r.text for r in file.runs(file.pages()[0])] == ["Abd"]


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(_pdf([place([["x", "1"], ["y", "2"]], 700)]))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    got = [(r.path.rsplit("/", 1)[1], r.page, r.table_no, r.row_no, r.fields) for r in pdf.read_pdf_tables(spark, str(tmp_path / "*.pdf")).collect()]
    assert got == [("a.pdf", 1, 0, 0, ["x", "1"]), ("a.pdf", 1, 0, 1, ["y", "2"])]
    assert pdf.table_rows(spark.createDataFrame([(1, None)], "id int, c binary"), "id", "c").count() == 0


def test_plain_text_is_read_in_one_search():
    plain = b"BT /F1 9 Tf 1 0 0 1 60.0 700 Tm (a b) Tj 1 0 0 1 160 700.0 Tm (c) Tj 7 1 0 0 1 60 -.5 Tm (d)Tj ET"
    assert sum(1 for _ in pdf._tokens(plain)) == 9
    # the same with an escape or as an array is read token by token
    slow = plain.replace(b"(a b)", b"(\\141 b)").replace(b"(c) Tj", b"[(c)] TJ").replace(b"(d)Tj", b"<64> Tj")
    assert list(pdf._show(plain, {})) == list(pdf._show(slow, {})) and len(list(pdf._show(plain, {}))) == 3
    inside = b"BT [1 0 0 1 5 5 Tm (x) Tj] TJ ET"
    assert "placed" not in [k for k, _ in pdf._tokens(inside)]


def test_a_file_takes_few_calls():
    data = _pdf([place([["part 1", "R", "1", "17", "1996-01-02"], *[["part 2", "A", str(n), "5", "1996-01-02"] for n in range(6)]], 700)])
    want, calls = read(data), []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        got = read(data)
    finally:
        sys.setprofile(None)
    assert got == want and len(got[0][0]) == 7 and len([c for c in calls if c.endswith("call")]) < 1000


def test_ends_of_streams_and_objects():
    page = b"1 0 obj << /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents 2 0 R >> endobj "
    for end in (b"\n", b"\r\n", b"\r", b""):
        data = page + b"2 0 obj << >> stream\r\nBT 1 0 0 1 5 5 Tm (an_endobj) Tj" + end + b"endstream endobj 3 0 obj << /Type /Font >> cut"
        file = pdf.PdfFile(data)
        assert [r.text for r in file.runs(file.pages()[0])] == ["an_endobj"] and sorted(file.bodies) == [1, 2]
        assert file.stream(2).endswith(b"Tj")


def test_plain_pages_are_read_in_one_go():
    file = pdf.PdfFile(_pdf([[(60.0, 700.0, "a b"), (160.0, 700.0, " "), (220.0, 688.5, "é")]]))
    page = file.pages()[0]
    fonts, data = file._fonts_of(page), file.stream(5)
    plain = pdf._show_plain(data, fonts)
    assert [r.text for r in plain] == ["a b", "é"] and plain == list(pdf._show(data, fonts)) == file.runs(page)
    for other in (data.replace(b" ET", b" q ET"), data.replace(b"Tf ", b"Tf 2 Tw "), data.replace(b"(a b)", b"(a\\051)"), data.replace(b"/F1", b"/F2"), data.replace(b"Tj 1", b"Tj 7 1", 1), data[:-2]):
        assert pdf._show_plain(other, fonts) is None
