"""Registered plans on documents, pages and conversations."""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import headings, html, items, names, predicates, text
from ..scratch import new_folder
from ..streaming import incremental, keyed
from ..sources import pdf
from . import register, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@register("item_split", """
    with s as (select doc_id, string_split(text, chr(10)) as p from documents)
    select doc_id, generate_subscripts(p, 1)::int - 1 as item_no, unnest(p) as body from s""")
def item_split(spark, sf):
    # a line end is the marker; each body runs to the next one
    cut = items.split_items(_docs(spark, sf).withColumn("text", F.concat(F.lit("\n"), "text")), "doc_id", "text", "(?i)(\n)", before="start", keep=True)
    return cut.select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("item_no")).cast("int").alias("n"), "body").select("doc_id", (F.col("n") - 1).alias("item_no"), "body")


@register("first_non_null_merge", "select conv_id, arg_min(case when role = 'user' then text end, turn) filter (role = 'user') as asked, arg_min(text, turn) filter (role = 'assistant') as answered from conversations group by 1")
def first_non_null_merge(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).alias("asked"), F.when(F.col("role") == "assistant", F.col("text")).alias("answered"))
    return text.merge_first_known(c, ["conv_id"], [F.col("turn")], ["asked", "answered"])


@register("page_titles", r"select page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') as title from pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))


@register("incremental_ingest", "select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def incremental_ingest(spark, sf):
    out = incremental.ingest_once(spark, f"{sf}/events.parquet", ["event_id"], "ts", "30 days")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@register("newest_events", "select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id::varchar desc) = 1")
def newest_events(spark, sf):
    """The newest event of each user, folded with keyed state from files that each hold all times, a third of them a batch: the number of batches does not grow with the table."""
    root, files = new_folder(spark, "newest"), max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type").repartition(files, "event_id").write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    keyed.fold_newest(spark, f"{root}/in", schema, f"{root}/changes", f"{root}/log", ["user_id"], "ts", files_per_batch=-(-files // 3)).awaitTermination()
    return keyed.newest(spark, schema, f"{root}/changes", ["user_id"]).select("user_id", "event_id", "ts", "event_type")


@register("unparsed_batch", "select conv_id, turn from conversations where length(text) <= 200")
def unparsed_batch(spark, sf):
    return predicates.not_too_long(table(spark, sf, "conversations"), "text", 200).select("conv_id", "turn")


@register("names_found_again", """
    with t as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'), lambda x: lower(x)) as t from documents),
    n as (select doc_id, t, [t[1:3], t[1:2], t[4:4]] as names from t where len(t) >= 4 and len(list_distinct(t[1:4])) = 4),
    h as (select doc_id, unnest([1, 2, 3]) as name_no, unnest(names) as name, names, t from n),
    p as (select doc_id, name_no, len(list_filter(range(1, len(t) + 1), lambda i: t[i:i + len(name) - 1] = name and (name_no <> 2 or t[i:i + 2] <> names[1]))) as places from h)
    select doc_id, name_no, places::bigint as places from p where places > 0""")
def names_found_again(spark, sf):
    """The first three words of a document, the first two, and the fourth, found again in its whole text in any case; where the first two begin the first three, the longer counts."""
    token = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"), F.lit(0))
    d = _docs(spark, sf).withColumn("t", F.transform(F.slice(token, 1, 4), F.lower)).where("size(t) = 4 and size(array_distinct(t)) = 4")
    name = lambda a, n: F.struct(F.array_join(F.slice("t", a, n), " ").alias("name"), F.lit(0).alias("since"))
    given = F.array(name(1, 3), name(1, 2), name(4, 1))
    hits = d.select("doc_id", F.transform(given, lambda x: x["name"]).alias("names"), F.explode(names.find_names(F.col("text"), given, fold=True)).alias("h"))
    return hits.groupBy("doc_id", F.array_position("names", F.col("h.name")).cast("int").alias("name_no")).agg(F.count("*").alias("places"))


#: group, and what stands before, at the start, at the end and after a heading of it
_STYLES = (
    ("center_b", '<p align="CENTER">', "<b>", "</b>", "</p>"),
    ("textcenter_strong", '<div style="text-align:center">', "<strong>", "</strong>", "</div>"),
    ("textcenter_b", '<div style="TEXT-ALIGN: center"><i>', "<b>", "</b>", "</i></div>"),
    ("textcenter_weight", '<div style="text-align: center">', '<span style="font-weight:bold">', "</span>", "</div>"),
    ("td_textcenter_font_b", '<table><tr><td style="text-align:center"><font>', "<b>", "</b>", "</font></td></tr></table>"),
    ("td_textcenter_font_weight", '<table><tr><td style="text-align:center">', '<font style="font-weight: 700">', "</font>", "</td></tr></table>"),
    ("b_u", "<p><b>", "<u>", "</u>", "</b></p>"),
    ("font_bold_text_align_center_parent", '<div style="font: bold 10pt Times; text-align:center">', '<font size="2">', "</font>", "</div>"),
)
_STYLE_ROWS = ", ".join("(" + ", ".join(f"'{x}'" for x in (n, *s)).replace(f"'{n}'", str(n), 1) + ")" for n, s in enumerate(_STYLES))


@register("styled_headings", f"""
    with s(n, grp, pre, o, c, post) as (values {_STYLE_ROWS}),
    t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') as t from documents), h as (select * from t join s on n = doc_id % 8 where len(t) >= 5)
    select doc_id, 0::int as number, grp as "group", true as main, upper(t[1] || ' ' || t[2]) as text, 2::int as lines, 0::int as under, o || upper(t[1]) || c || post || chr(10) || pre || o || upper(t[2]) || c as source from h
    union all select doc_id, 1, grp, false, lower(t[3] || ' ' || t[4]), 1, 0, o || lower(t[3] || ' ' || t[4]) || c from h
    union all select doc_id, 2, grp, true, upper(t[5]), 1, 2, o || upper(t[5]) || c from h""")
def styled_headings(spark, sf):
    """Whole documents as pages, their first words as headings in one of eight styles: two lines of a main heading, a heading under it, and the text before another main one."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for n, s in enumerate(_STYLES) for x in (n, s[i])]), (F.col("doc_id") % 8).cast("int"))
    d = _docs(spark, sf).withColumn("t", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))).where("size(t) >= 5")
    pre, opened, closed, post = (pick(i) for i in range(1, 5))
    word = lambda i: F.get("t", F.lit(i))
    heading = lambda x: F.concat(pre, opened, x, closed, post)
    body = F.concat(F.lit("<p>"), F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), F.lit("</p>"))
    page = F.concat(heading(F.upper(word(0))), F.lit("\n"), heading(F.upper(word(1))), heading(F.lower(F.concat(word(2), F.lit(" "), word(3)))), body, heading(F.upper(word(4))), body)
    # the narrower styles first: each of the eight then picks its own headings
    found = headings.styled_headings(d.select("doc_id", page.alias("html")), "doc_id", "html", dict(reversed(headings.GROUPS.items())))
    return found.join(d.select("doc_id", page.alias("html")), "doc_id").select("doc_id", "number", "group", "main", "text", "lines", "under", F.substr("html", F.col("start") + 1, F.col("end") - F.col("start")).alias("source"))


@register("titles_aligned", """
    with t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]{3,}')[1:9] as t from documents), d as (select doc_id from t where len(t) = 9 and len(list_distinct(t)) = 9)
    select doc_id, n::int as title_no, place::int as heading_no, k::int as joined from d, (values (0, 1, 1), (1, 2, 1), (2, 4, 2)) v(n, place, k)""")
def titles_aligned(spark, sf):
    """Nine words of a document make three titles; their headings have a line break, lack a word, come twice, or stand in two lines."""
    d = _docs(spark, sf).withColumn("t", F.slice(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,}"), F.lit(0)), 1, 9)).where("size(t) = 9 and size(array_distinct(t)) = 9")
    title = lambda a, n: F.array_join(F.slice("t", a, n), " ")
    broken = F.upper(F.array_join(F.slice("t", 1, 3), "\n "))
    lacking = F.concat_ws(" ", *[F.get("t", F.lit(i)) for i in (3, 4, 6)])
    found = F.array(F.lit("..."), broken, lacking, title(1, 3), title(8, 1), title(9, 1))
    return headings.aligned_titles(d.select("doc_id", F.array(title(1, 3), title(4, 4), title(8, 2)).alias("titles"), found.alias("found")), "doc_id", "titles", "found")


@register("spanned_tables", """
    with l as (select l_orderkey, l_returnflag, l_linenumber, l_quantity::bigint as q, row_number() over (partition by l_orderkey order by l_returnflag, l_linenumber, l_quantity, l_extendedprice) as r from lineitem)
    select l_orderkey, (r - 1)::int as row_no, l_orderkey::varchar || '/' || l_returnflag || '/' || l_linenumber || '/' || q || '/' as fields from l""")
def spanned_tables(spark, sf):
    """A table for each order: its key spans all rows, a flag the rows of its lines, and the quantity two columns."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice", F.col("l_quantity").cast("long").alias("q"))
    w = W.partitionBy("l_orderkey")
    lines = li.withColumn("r", F.row_number().over(w.orderBy("l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice"))).withColumn("n", F.count("*").over(w))
    flag = W.partitionBy("l_orderkey", "l_returnflag")
    lines = lines.withColumn("f", F.count("*").over(flag)).withColumn("first", F.min("r").over(flag))
    cell = lambda text, **spans: F.concat(F.lit("<td"), *[F.concat(F.lit(f' {k}="'), v.cast("string"), F.lit('"')) for k, v in spans.items()], F.lit(">"), text.cast("string"), F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), F.when(F.col("r") == 1, cell(F.col("l_orderkey"), rowspan=F.col("n"))).otherwise(""), F.when(F.col("r") == F.col("first"), cell(F.col("l_returnflag"), rowspan=F.col("f"))).otherwise(""), cell(F.col("l_linenumber")), cell(F.col("q"), colspan=F.lit(2)), F.lit("</tr>"))
    # an order has a few lines
    pages = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", tr.alias("tr")))).alias("rows")).select("l_orderkey", F.concat(F.lit("<table>"), F.array_join(F.col("rows.tr"), ""), F.lit("</table>")).alias("html"))
    return html.table_rows(pages, "l_orderkey", "html").select("l_orderkey", "row_no", F.array_join("fields", "/").alias("fields"))


_SPECIAL = re.compile(r"([\\()])")
_FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [" + b"600 " * 256 + b"] >>"


@lru_cache(4096)
def _at(x: float, y: float) -> str:
    return f"1 0 0 1 {x:.1f} {y:.1f} Tm ("


def _pdf(pages: list[list[tuple[float, float, str]]]) -> bytes:
    """A PDF whose pages show texts at given places, as a printer driver writes one."""
    kids = " ".join([f"{4 + 2 * i} 0 R" for i in range(len(pages))])
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), _FONT]
    for i, shown in enumerate(pages):
        if _SPECIAL.search("".join([t for _, _, t in shown])):
            shown = [(x, y, _SPECIAL.sub(r"\\\1", t)) for x, y, t in shown]
        # a small window: a page's text is short, and the tables of a large one take longer to set up than the text to pack
        packer = zlib.compressobj(1, zlib.DEFLATED, 12, 5)
        body = packer.compress(("BT /F1 9 Tf " + " ".join([f"{_at(x, y)}{t}) Tj" for x, y, t in shown]) + " ET").encode("cp1252", "replace")) + packer.flush()
        objects.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * i} 0 R >>".encode())
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(body), body))
    return b"%PDF-1.4\n" + b"".join([b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1)]) + b"trailer << /Root 1 0 R >>\n%%EOF"


@register("pdf_tables", """
    with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as r, count(*) over (partition by l_orderkey) as n from lineitem)
    select l_orderkey, 1::int as page, (r - 1)::int as row_no, 'part ' || l_partkey || '|' || l_linenumber || '|' || l_quantity::bigint as fields from l where n > 1""")
def pdf_tables(spark, sf):
    """A PDF for each order with its lines as a table of five columns under a heading; the reader gives back three of them. A single line is no table."""
    shown = "concat_ws('|', concat('part ', l_partkey), l_returnflag, l_linenumber, cast(l_quantity as bigint), cast(l_shipdate as string)) as t"
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", f"struct(l_linenumber, l_partkey, l_quantity, l_extendedprice, {shown}) as l")
    # a stated number of partitions: drawing and reading take time, not bytes; an order has a few lines
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = li.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l"))["t"], "\n").alias("lines"))

    def draw(batches):
        for batch in batches:
            made = []
            for key, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells = [(left, 700.0 - 12 * n, t) for n, row in enumerate(rows.split("\n")) for left, t in zip((60.0, 160.0, 220.0, 290.0, 360.0), row.split("|"), strict=True)]
                made.append(_pdf([[(60.0, 740.0, f"Order {key}"), *cells]]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(made, pa.binary())], names=["l_orderkey", "content"])

    files = orders.mapInArrow(draw, "l_orderkey long, content binary")
    return pdf.table_rows(files, "l_orderkey", "content").select("l_orderkey", "page", "row_no", F.array_join("fields", "|").alias("fields"))
