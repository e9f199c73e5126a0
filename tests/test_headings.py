"""Heading styles, aligned titles and spanned tables against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import headings as H
from factloom.operators import html, items

PAGES = {
    "center_b": '<p align="Center">x <i><b>{}</b></i></p>',
    "textcenter_strong": '<div style="color:red; text-align: center"><strong>{}</strong></div>',
    "textcenter_b": '<div style="text-align:center"><i><b>{}</b></i></div>',
    "textcenter_weight": '<div style="text-align:CENTER"><span style="font-weight: bold">{}</span></div>',
    "td_textcenter_font_b": '<td style="text-align:center"><font><b>{}</b></font></td>',
    "td_textcenter_font_weight": '<td style="text-align: center"><font style="font-weight:700">{}</font></td>',
    "b_u": "<b><u>{}</u></b>",
    "font_bold_text_align_center_parent": '<p style="text-align:center;font:bold 9pt x"><i><font>{}</font></i></p>',
}
NOT = {
    "center_b": "<p><b>{}</b></p>",
    "textcenter_strong": '<div style="text-align:center"><i><strong>{}</strong></i></div>',
    "textcenter_b": '<div style="text-align:left"><b>{}</b></div>',
    "textcenter_weight": '<div style="text-align:center"><i><span style="font-weight:bold">{}</span></i></div>',
    "td_textcenter_font_b": '<div style="text-align:center"><font><b>{}</b></font></div>',
    "td_textcenter_font_weight": '<td style="text-align:center"><font style="font-weight:400">{}</font></td>',
    "b_u": "<b><i><u>{}</u></i></b>",
    "font_bold_text_align_center_parent": '<p style="text-align:center"><font style="font:bold">{}</font></p>',
}


@pytest.mark.parametrize("group", sorted(H.GROUPS))
def test_each_group_alone(group):
    only = {group: H.GROUPS[group]}
    page = PAGES[group].format("RISK &amp; FACTORS") + "<p>text</p>" + PAGES[group].format("a sub one") + NOT[group].format("NO")
    found = H.headings(page, only)
    assert [(h.main, h.text) for h in found] == [(True, "RISK & FACTORS"), (False, "a sub one")]
    for h in found:
        piece = page[h.start : h.end]
        assert piece.startswith("<") and piece.endswith(">") and h.text.replace("&", "&amp;") in piece
    assert H.headings(NOT[group].format("NO"), only) == []


def test_lines_of_one_heading():
    line = PAGES["b_u"].format
    page = line("RISK") + "\n" + line("FACTORS OF") + line("it") + line("USE") + "." * 500 + line("PLAN")
    assert [(h.text, h.lines, h.main) for h in H.headings(page)] == [("RISK FACTORS OF", 2, True), ("it", 1, False), ("USE", 1, True), ("PLAN", 1, True)]
    assert H.headings(None) == [] and H.headings("<b><u>  </u></b><script><b><u>X</u></b></script>") == []
    assert [h.text for h in H.headings("<b><u>OPEN to the end")] == ["OPEN to the end"]


def test_matcher_by_walking_up():
    """Random trees: the automaton picks what walking up from each tag picks."""
    rnd = random.Random(8)

    def passes(step, tag, attrs):
        import re

        _, want, style, align = step
        return (want in (None, tag)) and (style is None or re.search(style, attrs.get("style", ""), re.I | re.S) is not None) and (align is None or attrs.get("align", "") == align)

    def climbs(steps, path):
        if not passes(steps[-1], *path[-1]):
            return False
        if len(steps) == 1:
            return True
        above = [path[:-1]] if steps[-1][0] == ">" else [path[:i] for i in range(1, len(path))]
        return any(p and climbs(steps[:-1], p) for p in above)

    matcher = H.Matcher()
    for _ in range(1500):
        path, state = [], (0, 0)
        for _ in range(rnd.randrange(1, 6)):
            tag = rnd.choice(["b", "u", "font", "td", "strong", "p"])
            attrs = {"style": rnd.choice(["", "text-align:center", "font-weight:bold", "font: bold; text-align: center", "text-align:center;font-weight: 700"]), "align": rnd.choice(["", "center"])}
            path.append((tag, attrs))
            state = matcher.push(state, tag, attrs)
            assert matcher.group(state) == next((g for g, steps in H.GROUPS.items() if climbs(steps, path)), None)


def test_styled_headings_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, PAGES["center_b"].format("A") + PAGES["b_u"].format("b"))], "id long, html string")
    got = [tuple(r) for r in H.styled_headings(df, "id", "html").select("id", "number", "group", "main", "text", "under").collect()]
    assert got == [(3, 0, "center_b", True, "A", 0), (3, 1, "b_u", False, "b", 0)]


def by_trying(titles, found, most, join):
    """The least total cost over every order-preserving matching."""
    t, h = [H.shape(x) for x in titles], [H.shape(x) for x in found]

    def go(i, j):
        if i == len(t):
            return 0.0
        best = 1 + go(i + 1, j)
        for a, k in itertools.product(range(j, len(h)), range(1, join + 1)):
            if a + k <= len(h) and h[a] and h[a + k - 1]:
                run = sum(h[a : a + k], [])
                if len(run) <= 2 * len(t[i]) + 2 and (len(t[i]) == 1 or set(t[i]) & set(run)) and (c := H.title_cost(t[i], run)) <= most:
                    best = min(best, c + go(i + 1, a + k))
        return best

    return go(0, 0)


def test_alignment_costs_least():
    rnd = random.Random(9)
    words = ["risk", "risks", "factors", "use", "of", "proceeds", "proceed", "plan", ""]
    for _ in range(150):
        titles = [" ".join(rnd.choices(words, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(4))]
        found = [" ".join(rnd.choices(words, k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(6))]
        got = H.align(titles, found)
        assert [(i, j) for i, j, _ in got] == sorted((i, j) for i, j, _ in got) and all(a[1] + a[2] <= b[1] for a, b in zip(got, got[1:], strict=False))
        cost = sum(H.title_cost(H.shape(titles[i]), sum((H.shape(x) for x in found[j : j + k]), [])) for i, j, k in got) + len(titles) - len(got)
        assert abs(cost - by_trying(titles, found, 0.34, 3)) < 1e-9


def test_alignment_of_a_filing():
    titles = ["ABOUT THIS PROSPECTUS", "RISK FACTORS", "USE OF PROCEEDS", "DESCRIPTION OF CAPITAL STOCK WE MAY OFFER", "PLAN OF DISTRIBUTION", "LEGAL MATTERS"]
    found = ["Prospectus", "ABOUT THIS\n PROSPECTUS", "Risk Factors", "RISK FACTORS", "Use of the Proceeds", "DESCRIPTION OF CAPITAL", "STOCK WE MAY OFFER", "PLAN OF DISTRIBUTION", "USE OF PROCEEDS", "Legal Maters"]
    assert H.align(titles, found) == [(0, 1, 1), (1, 2, 1), (2, 4, 1), (3, 5, 2), (4, 7, 1), (5, 9, 1)]


def test_sections_follow_titles_with_gaps():
    toc = "<table><tr><td>RISK FACTORS</td><td>1</td></tr><tr><td>USE OF PROCEEDS</td><td>2</td></tr><tr><td>PLAN OF DISTRIBUTION</td><td>3</td></tr></table>"
    body = "".join(f'<p align="center"><b>{h}</b></p><p>{b}</p>' for h, b in [("RISK\nFACTORS", "one."), ("USE OF THE PROCEEDS", "two."), ("PLAN OF DISTRIBUTON", "three."), ("USE OF PROCEEDS", "again.")])
    got = [(s["title"], s["strategy"], s["text"]) for s in html.sections(toc + body)]
    assert [g[0] for g in got if g[0] != "before"] == ["RISK FACTORS", "USE OF PROCEEDS", "PLAN OF DISTRIBUTION"] and {g[1] for g in got} == {"toc_titles"}
    assert [g[2] for g in got][-3:] == ["RISK FACTORS one.", "USE OF THE PROCEEDS two.", "PLAN OF DISTRIBUTON three. USE OF PROCEEDS again."]


def painted(rows):
    """Each cell painted place by place."""
    canvas = {}
    for r, row in enumerate(rows):
        c = 0
        for text, wide, deep in row:
            while (r, c) in canvas:
                c += 1
            for dr in range(deep if deep else len(rows) - r):
                for dc in range(wide):
                    if r + dr < len(rows) and (r + dr, c + dc) not in canvas:
                        canvas[r + dr, c + dc] = text if dc == 0 else ""
            c += wide
    return [[canvas.get((r, c), "") for c in range(1 + max((x for y, x in canvas if y == r), default=-1))] for r in range(len(rows))]


def test_grid_by_painting():
    rnd = random.Random(10)
    for _ in range(200):
        rows = [[(f"t{rnd.randrange(99)}", rnd.choice([1, 1, 1, 2, 3]), rnd.choice([1, 1, 2, 3, 0])) for _ in range(rnd.randrange(5))] for _ in range(rnd.randrange(6))]
        source = "<table>" + "".join("<tr>" + "".join(f'<td colspan="{w}" rowspan="{d}">{t}</td>' for t, w, d in row) + "</tr>" for row in rows) + "</table>"
        (table,) = html.parse(source).tables
        assert html.grid(table) == painted(rows), source
    assert html.grid(html.parse('<table><tr><td rowspan="x" colspan="-1">a').tables[0]) == [["a"]]


def test_nested_tables_keep_their_rows(spark):
    page = '<table><tr><td rowspan="2">a<table><tr><td>in</td></tr></table></td><td>b</td></tr><tr><td>c</td></tr></table>'
    got = [tuple(r) for r in html.table_rows(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html").orderBy("table_no", "row_no").collect()]
    assert got == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["a", "c"]), (1, 1, 0, ["in"])]


def test_schedule_over_two_tables(spark):
    rows = [[["1", "NAME OF REPORTING PERSON"], ["", "Fund One"]], [["2", "CITIZENSHIP"], ["", "Delaware"]]]
    df = spark.createDataFrame([([(r,) for r in rows],)], "t array<struct<rows: array<array<string>>>>")
    keys = ["NAME OF REPORTING PERSON", "CITIZENSHIP"]
    found = df.select(items.main_table_of(F.col("t"), keys).alias("m")).first().m
    assert found["CITIZENSHIP"] == "Delaware" and found["NAME OF REPORTING PERSON"].startswith("Fund One")
