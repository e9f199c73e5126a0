"""Registered plans on whole filings: fact JSON, submissions, pages, notices and commands, all written from the sample tables so that each SQL twin knows what must come out."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cash, commands, extract, facts, graph, html, items, paths, predicates, state, text
from ..operators import command_log as command_log_
from ..scratch import new_folder
from ..sources import files, schemas
from . import register, table

# ---- facts: a companyfacts document for each customer, a few facts for each order

_O = "o as (select o_custkey as c, o_orderkey as k, o_orderdate::date as day, o_totalprice as v from orders)"
_TAGGED = f"""{_O}, f as (
    select c, 'us-gaap' as taxonomy, 'Cash' as tag, null::date as start, day as "end", v as val, year(day)::int as fy from o where k % 3 = 0
    union all select c, 'us-gaap', 'CashAndCashEquivalentsAtCarryingValue', null, day, v * 0.5, year(day) from o
    union all select c, 'us-gaap', 'NetCashProvidedByUsedInOperatingActivities', date_trunc('year', day)::date, day, case when k % 2 = 0 then v else -v end, (1990 + k % 9) from o
    union all select c, 'us-gaap', 'NetCashProvidedByUsedInInvestingActivities', date_trunc('year', day)::date, day, -v * 0.25, (1990 + k % 9) from o where k % 2 = 0
    union all select c, 'us-gaap', 'NetCashProvidedByUsedInFinancingActivities', date_trunc('year', day)::date, day, v * 0.125, (1990 + k % 9) from o where k % 5 < 3
    union all select c, 'dei', 'EntityCommonStockSharesOutstanding', null, day, (k % 1000)::double, year(day) from o)"""


def _documents(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("v"))
    fact = lambda taxonomy, tag, start, val, fy, when="true": F.when(F.expr(when), F.struct(F.lit(taxonomy).alias("taxonomy"), F.lit(tag).alias("tag"), F.expr(f"named_struct('start', cast({start} as date), 'end', day, 'val', cast({val} as double), 'fy', cast({fy} as int))").alias("row")))
    year = "trunc(day, 'year')"
    made = F.array(
        fact("us-gaap", "Cash", "null", "v", "year(day)", "k % 3 = 0"), fact("us-gaap", "CashAndCashEquivalentsAtCarryingValue", "null", "v * 0.5", "year(day)"),
        fact("us-gaap", "NetCashProvidedByUsedInOperatingActivities", year, "if(k % 2 = 0, v, -v)", "1990 + k % 9"), fact("us-gaap", "NetCashProvidedByUsedInInvestingActivities", year, "-v * 0.25", "1990 + k % 9", "k % 2 = 0"),
        fact("us-gaap", "NetCashProvidedByUsedInFinancingActivities", year, "v * 0.125", "1990 + k % 9", "k % 5 < 3"), fact("dei", "EntityCommonStockSharesOutstanding", "null", "k % 1000", "year(day)"),
    )
    # dealt once: the groupings below keep a customer together
    rows = o.repartition("c").select("c", F.explode(F.array_compact(made)).alias("f")).select("c", "f.*")
    tags = rows.groupBy("c", "taxonomy", "tag").agg(F.create_map(F.lit("USD"), F.collect_list("row")).alias("units"))
    taxonomies = tags.groupBy("c", "taxonomy").agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units")))).alias("tags"))
    whole = taxonomies.groupBy("c").agg(F.map_from_entries(F.collect_list(F.struct("taxonomy", "tags"))).alias("facts"))
    return whole.select("c", F.to_json(F.struct("facts")).alias("json"))


def _facts(spark, sf):
    return facts.explode_facts(_documents(spark, sf), "c", "json")


def _days(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@register("facts_exploded", f"with {_TAGGED} select c, taxonomy, tag, 'USD' as unit, strftime(start, '%Y-%m-%d') as start, strftime(\"end\", '%Y-%m-%d') as \"end\", val, fy::int as fy from f")
def facts_exploded(spark, sf):
    return _days(_facts(spark, sf), "start", "end")


@register("facts_outstanding", f"with {_TAGGED} select c, strftime(\"end\", '%Y-%m-%d') as \"end\", max(val) as val, tag from f where taxonomy = 'dei' group by c, \"end\", tag")
def facts_outstanding(spark, sf):
    return _days(facts.outstanding_shares(_facts(spark, sf), "c"), "end")


@register("facts_net_cash", f"with {_TAGGED} select c, strftime(\"end\", '%Y-%m-%d') as \"end\", max(val) as val from f where tag in {facts.CASH_TAGS} group by c, \"end\"")
def facts_net_cash(spark, sf):
    return _days(facts.net_cash(_facts(spark, sf), "c"), "end")


@register("facts_review_cash", f"with {_TAGGED} select c, strftime(\"end\", '%Y-%m-%d') as \"end\", " + ", ".join(f"max(val) filter (tag = '{t}') as \"{t}\"" for t in facts.CASH_TAGS) + f" from f where tag in {facts.CASH_TAGS} group by c, \"end\"")
def facts_review_cash(spark, sf):
    return _days(facts.review_cash(_facts(spark, sf), "c"), "end")


_FLOW = {kind: f"select c, '{kind}' as kind, start, \"end\", val from f where tag = '{tag}' qualify row_number() over (partition by c, start, \"end\" order by {'fy, val' if kind == 'financing' else 'fy desc, val desc'}) = 1" for kind, (_, tag) in facts.FLOW_TAGS.items()}
_FLOWS = f"{_TAGGED}, w as ({' union all '.join(f'({s})' for s in _FLOW.values())})"


def _flows(spark, sf):
    return facts.cash_flows(_facts(spark, sf), "c")


@register("facts_cash_flow", f"with {_FLOWS} select c, kind, strftime(start, '%Y-%m-%d') as start, strftime(\"end\", '%Y-%m-%d') as \"end\", val from w")
def facts_cash_flow(spark, sf):
    return _days(_flows(spark, sf), "start", "end").select("c", "kind", "start", "end", "val")


_BURN = f"""{_FLOWS}, r as (select *, val / nullif("end" - start, 0) as rate from w),
    b as (select c, start, "end", max(rate) filter (kind = 'operating') as op, max(rate) filter (kind = 'investing') as inv, max(rate) filter (kind = 'financing') as fin from r group by 1, 2, 3),
    l as (select *, coalesce(op, 0) + coalesce(inv, 0) as total from b qualify "end" = max("end") over (partition by c, start))"""


def _burn(spark, sf):
    return cash.burn_rates(_flows(spark, sf).selectExpr("c", "kind", "start as from_date", "`end` as to_date", "val as amount"), "c")


@register("facts_burn", f"with {_BURN} select c, strftime(start, '%Y-%m-%d') as from_date, strftime(\"end\", '%Y-%m-%d') as to_date, op as burn_rate_operating, inv as burn_rate_investing, fin as burn_rate_financing, total as burn_rate_total from l")
def facts_burn(spark, sf):
    return _days(_burn(spark, sf), "from_date", "to_date")


@register("facts_runway", f"""with {_BURN},
    n as (select c, "end" as day, max(val) as amount from f where tag in {facts.CASH_TAGS} group by 1, 2 qualify row_number() over (partition by c order by "end" desc) = 1),
    x as (select * from l qualify row_number() over (partition by c order by "end" desc, start desc) = 1)
    select c, round(case when total >= 0 then 'infinity'::double else abs(amount + total * (date '2002-01-01' - day)) / abs(total) end, 2) as days_of_cash, '2002-01-01' as days_of_cash_date from n join x using (c)""")
def facts_runway(spark, sf):
    net = facts.net_cash(_facts(spark, sf), "c").selectExpr("c", "`end` as instant", "val as amount")
    return _days(cash.runway(net, _burn(spark, sf), "c", "2002-01-01").select("c", "days_of_cash", "days_of_cash_date"), "days_of_cash_date")


# ---- sources: files written to the shared folder and read back

@register("source_facts", "select lpad(n_nationkey::varchar, 10, '0') as cik, n_regionkey::double as val from nation")
def source_facts(spark, sf):
    root = new_folder(spark, "companyfacts")
    n = table(spark, sf, "nation").select(F.format_string("CIK%010d.json", "n_nationkey").alias("file"), F.format_string('{"facts": {"dei": {"T": {"units": {"USD": [{"end": "2020-01-01", "val": %d}]}}}}}', "n_regionkey").alias("value"))
    n.repartition(8, "file").write.partitionBy("file").text(root)
    return facts.explode_facts(files.read_companyfacts(spark, f"{root}/*/*.txt"), "cik", "json").select("cik", "val")


_LINKS = """s as (select c_custkey as c, o_orderkey as k, o_orderdate::date as day from customer join orders on o_custkey = c_custkey)"""


def _submissions(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").cast("string").alias("day"))
    r = o.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("k", "day"))).alias("r"))
    fields = {"accessionNumber": "format_string('%010d-%02d-%06d', x.k, 20, 7)", "filingDate": "x.day", "form": "if(x.k % 2 = 0, 'S-3', '8-K')", "fileNumber": "concat('333-', x.k)", "primaryDocument": "concat('d', x.k, '.htm')", "primaryDocDescription": "if(x.k % 3 = 0, null, 'Report')"}
    recent = F.struct(*[F.expr(f"transform(r, x -> {e})").alias(n) for n, e in fields.items()])
    return r.select(F.col("c").cast("string").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))


@register("source_submissions", f"with {_LINKS} select lpad(c::varchar, 10, '0') as cik, lpad(k::varchar, 10, '0') || '20000007' as accn, case when k % 2 = 0 then 'S-3' else '8-K' end as form_type, strftime(day, '%Y-%m-%d') as filing_date, '333-' || k as file_number, case when k % 3 > 0 then 'Report' end as description, 'https://example.org/data/' || lpad(c::varchar, 10, '0') || '/' || lpad(k::varchar, 10, '0') || '20000007/d' || k || '.htm' as url from s")
def source_submissions(spark, sf):
    root = new_folder(spark, "submissions")
    _submissions(spark, sf).write.json(root)
    read = spark.read.schema(files.SUBMISSIONS_SCHEMA).json(root).withColumn("cik", F.lpad("cik", 10, "0"))
    return _days(predicates.submissions(read, "cik", "filings.recent", "https://example.org/data/"), "filing_date")


@register("source_codes", "select p_partkey::int as sic, p_brand as sector, p_type as industry, p_name as division from part")
def source_codes(spark, sf):
    root = new_folder(spark, "codes")
    table(spark, sf, "part").selectExpr("cast(p_partkey as int) as sic", "p_brand as sector", "p_type as industry", "p_name as division").write.csv(root, header=True)
    return files.read_sics(spark, root)


@register("source_overviews", "select s_name as name, lpad(s_suppkey::varchar, 10, '0') as cik, case when s_suppkey % 2 = 0 then '9999' else '1' || s_suppkey end as sic_code, case when s_suppkey % 2 = 0 then 'Nonclassifiable' else 'Made' end as sic_description from supplier where s_suppkey % 5 > 0")
def source_overviews(spark, sf):
    root = new_folder(spark, "overviews")
    s = table(spark, sf, "supplier").selectExpr("s_name as name", "if(s_suppkey % 5 > 0, format_string('%010d', s_suppkey), null) as cik", "if(s_suppkey % 2 = 0, null, concat('1', s_suppkey)) as sic_code", "if(s_suppkey % 2 = 0, null, 'Made') as sic_description")
    s.select(F.to_json(F.struct("*")).alias("value")).withColumn("part", F.expr("cast(uuid() as string)")).drop("part").write.text(root)
    rows = spark.read.schema(files.OVERVIEW_SCHEMA).json(root)
    return files.defaulted(rows).select("name", "cik", "sic_code", "sic_description")


@register("file_index", "select lpad((o_orderkey % 7)::varchar, 10, '0') as cik, '333-' || (o_orderkey % 50) as file_number, count(*) as n, min(o_orderkey) as first from orders group by 1, 2")
def file_index(spark, sf):
    root = new_folder(spark, "index")
    o = table(spark, sf, "orders").selectExpr("concat(format_string('%010d', o_orderkey % 7), '.csv') as cik_file", "'S-3' as form_type", "concat('333-', o_orderkey % 50) as file_number", "concat('a\\\\', o_orderkey, '.htm') as file_path", "cast(date_add(date'2000-01-01', cast(o_orderkey % 10000 as int)) as string) as filing_date")
    o.repartition(7, "cik_file").write.partitionBy("cik_file").csv(root, header=True)
    index = files.read_index(spark, f"{root}/*", "cik_file=([0-9]+)\\.csv/")
    by = files.index_by_file_number(index)
    number = F.transform("files", lambda x: F.regexp_extract(x["file_path"], "^a/([0-9]+)\\.htm$", 1).cast("long"))
    return by.select("cik", "file_number", F.size("files").cast("long").alias("n"), F.array_min(number).alias("first"))


@register("source_walk", "select doc_id, 'page ' || doc_id as content, '.txt' as extension, false as old from documents where doc_id % 10 = 0".replace("where doc_id % 10 = 0", ""))
def source_walk(spark, sf):
    root = new_folder(spark, "walk")
    d = table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(8)).alias("shelf"), F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("value"))
    d.repartition(8, "shelf").write.partitionBy("shelf").text(root)
    read = files.read_documents(spark, root, "*.txt").select("path", "extension", F.explode(F.split(F.regexp_replace("content", "\\s+$", ""), "\n")).alias("content"))
    old = files.files_older_than(spark, f"{root}/*/*.txt", 288, "2000-01-01 00:00:00").withColumn("old", F.lit(True))
    return read.join(old, "path", "left").select(F.substring("content", 6, 20).cast("long").alias("doc_id"), "content", "extension", F.coalesce("old", F.lit(False)).alias("old"))


@register("source_sql", "select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_orderstatus = 'F'")
def source_sql(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("sql_orders")
    files.run_sql_file(spark, "create or replace temporary view sql_done as\nselect * from sql_orders where o_orderstatus = 'F';\nselect count(*) from sql_done;\n")
    return files.read_sql(spark, "select o_orderkey, o_totalprice from sql_done where o_totalprice > :least", {"least": 100000})


@register("source_section_failures", """select page_id, case page_id % 3 when 1 then 'no text' else 'no section of this title' end as reason from pages where page_id % 3 > 0""")
def source_section_failures(spark, sf):
    """Raw pages whose title is wanted, empty ones, and those with another title."""
    p = table(spark, sf, "pages").select("page_id", F.expr("case page_id % 3 when 1 then '' when 2 then html else concat('<h1>WANTED ', page_id, '</h1><p>x</p>', html) end").alias("html"))
    return files.section_failures(p, html.split_sections(p, "page_id", "html"), "page_id", "^WANTED [0-9]+$")


@register("source_sections", "select page_id, 'Risk of ' || page_id as text from pages")
def source_sections(spark, sf):
    root = new_folder(spark, "sections")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<h2>RISK FACTORS</h2><p>Risk of "), F.col("page_id").cast("string"), F.lit("</p><h2>Other</h2><p>x</p>")).alias("html"))
    files.write_sections(html.split_sections(p, "page_id", "html").withColumn("text", F.regexp_replace("text", "^RISK FACTORS ", "")), "(?i)risk factors", "\n", root)
    return spark.read.text(root).select(F.regexp_extract("value", "([0-9]+)$", 1).cast("long").alias("page_id"), F.col("value").alias("text"))


@register("schema_keys", "select c_nationkey as nation, count(*) - 1 as extra from customer group by 1 having count(*) > 1")
def schema_keys(spark, sf):
    """Codes written into an empty table of the schema: keys that repeat are violations."""
    c = table(spark, sf, "customer").selectExpr("c_nationkey as id", "'s' as sector", "cast(c_custkey as string) as industry", "'d' as division")
    full = schemas.empty(spark, "sics").unionByName(c.selectExpr("cast(id as int) as sic", "sector", "industry", "division").select(*schemas.empty(spark, "sics").columns), allowMissingColumns=True)
    return full.groupBy(F.col("sic").alias("nation")).agg((F.count("*") - 1).alias("extra")).where("extra > 0")


# ---- pages

_TITLES = ("Use of Proceeds", "Plan of Distribution", "Legal Matters")
_TOC = "".join(f'<tr><td>{t}</td><td>{i + 3}</td></tr>' for i, t in enumerate(_TITLES))
_LINKED = "".join(f'<tr><td><a href="#s{i}">{t}</a></td><td>{i + 3}</td></tr>' for i, t in enumerate(_TITLES))
_BODY = "".join(f'<h2 id="s{i}">{t}</h2><p>Part {i} of page PAGE.</p>' for i, t in enumerate(_TITLES))
#: Kinds of page, by number modulo 5: links of the contents, its titles, headers only, two prospectuses, a note before the cover.
_KINDS = (
    f"<title>T</title><p>PROSPECTUS</p><table>{_LINKED}</table>{_BODY}", f"<p>PROSPECTUS</p><table>{_TOC}</table>{_BODY}", _BODY,
    f"<p>PROSPECTUS</p><table>{_LINKED.replace('#s', '#a')}</table>{_BODY.replace('id=\"s', 'id=\"a')}<p>PROSPECTUS</p><table>{_LINKED}</table>{_BODY}",
    f"<p>Form S-3</p><p>EXPLANATORY NOTE</p><p>Two parts.</p><p>PROSPECTUS</p><table>{_LINKED}</table>{_BODY}",
)
_COVERS = {0: 1, 1: 1, 2: 0, 3: 2, 4: 1}


def _pages(spark, sf):
    made = F.expr("case page_id % 5 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(_KINDS)) + " end")
    return table(spark, sf, "pages").select("page_id", F.replace(made, F.lit("PAGE"), F.col("page_id").cast("string")).alias("html"))


def _expected() -> str:
    rows = []
    for kind in range(5):
        titles = {0: ["cover page", *_TITLES], 1: ["cover page", *_TITLES], 2: [*_TITLES], 3: ["cover page", *_TITLES, "cover page", *_TITLES], 4: ["front page", "explanatory note", "cover page", *_TITLES]}[kind]
        filing = 0
        for n, t in enumerate(titles):
            filing += t == "cover page"
            strategy = ("toc_links", "toc_titles", "headers", "toc_links", "toc_links")[kind]
            rows.append(f"({kind}, {n}, '{t}', '{strategy}', {max(1, filing)})")
    return ", ".join(rows)


_SECTIONED = f"e(kind, number, title, strategy, filing_no) as (values {_expected()})"


@register("sections", f"""with {_SECTIONED} select page_id, number::int as number, title, strategy, filing_no::bigint as filing_no,
    case when title = 'cover page' then 0 when title in {_TITLES} then length(title || ' Part 0 of page ' || page_id || '.') when title = 'front page' then 8 else 27 end::int as n_chars,
    (title = 'cover page')::int as n_extracted from pages join e on page_id % 5 = kind""".replace("when title = 'cover page' then 0", "when title = 'cover page' then 10"))
def sections(spark, sf):
    cut = html.filing_numbers(html.split_sections(_pages(spark, sf), "page_id", "html"), "page_id")
    return html.summary(cut).select("page_id", "number", "title", "strategy", F.col("filing_no").cast("long").alias("filing_no"), "n_chars", "n_extracted")


@register("sections_whole")
def sections_whole(spark, sf):
    return html.summary(html.split_sections(table(spark, sf, "pages"), "page_id", "html")).drop("tables")


@register("section_lookup", f"with {_SECTIONED} select page_id, min(number)::int as number, count(*) as n from pages join e on page_id % 5 = kind where title like '%Matters' group by 1")
def section_lookup(spark, sf):
    cut = html.split_sections(_pages(spark, sf), "page_id", "html")
    first = html.section_like(cut, "page_id", "Matters$").select("page_id", "number")
    return first.join(html.section_like(cut, "page_id", "Matters$", first=False).groupBy("page_id").agg(F.count("*").alias("n")), "page_id")


@register("page_text", "select page_id, 'Head of ' || page_id || ' bold & plain' as text, 'Title ' || page_id || ' Head of ' || page_id || ' plain' as rest from pages")
def page_text(spark, sf):
    made = F.concat(F.lit("<html><head><title>Title "), F.col("page_id").cast("string"), F.lit("</title><style>p{}</style></head><body><h1>Head of "), F.col("page_id").cast("string"), F.lit("</h1>\n <p><b> bold &amp;</b>\n plain</p><script>x()</script></body></html>"))
    p = table(spark, sf, "pages").select("page_id", made.alias("html"))
    return html.text_content(p, "page_id", "html").join(html.text_content(p, "page_id", "html", ("b",)).withColumnRenamed("text", "rest"), "page_id")


def _tabled(spark, sf):
    """Pages with a registration table (with or without a total), a bullet list, one row and nothing."""
    head = "<tr><th>Title of each class of securities to be registered</th><th>Amount to be registered</th><th>Proposed maximum aggregate offering price</th><th>Amount of registration fee</th></tr>"
    row = "<tr><td>Common stock</td><td>%NUM</td><td>$%NUM,000</td><td>5</td></tr>"
    total = "<tr><td> </td></tr><tr><td>Total</td><td></td><td>$%NUM,500</td><td>7</td></tr>"
    kinds = (f"<table>{head}{row}</table>", f"<table>{head}{row}{row}{total}</table>", "<table><tr><td>•</td><td>one</td></tr><tr><td>•</td><td>two %NUM</td></tr></table>", "<table><tr><td>a</td><td colspan=2>b %NUM</td></tr></table>", "<table><tr><td> </td></tr></table>", "<table><tr><td>x</td></tr><tr><td>y %NUM</td></tr></table>")
    made = F.expr("case page_id % 6 " + " ".join(f"when {i} then '{h}'" for i, h in enumerate(kinds)) + " end")
    p = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<h2>HEAD</h2>"), F.replace(made, F.lit("%NUM"), F.col("page_id").cast("string"))).alias("html"))
    return html.split_sections(p, "page_id", "html").where("title = 'HEAD'").select("page_id", "text", F.explode("tables").alias("t"))


@register("page_tables", """select page_id, case page_id % 6 when 0 then 'registration_table' when 1 then 'registration_table' when 2 then 'ul_bullet_points' when 3 then 'one_row_table' when 4 then 'empty' else 'unclassified' end as classification,
    case when page_id % 6 in (2, 3, 4) then 'reintegrated' else 'extracted' end as kind, case page_id % 6 when 0 then page_id || ',000' when 1 then page_id || ',500' end as capacity,
    case page_id % 6 when 2 then 'HEAD • one' || chr(10) || '• two ' || page_id when 3 then 'HEAD a' || chr(9) || 'b ' || page_id else 'HEAD' end as text, case page_id % 6 when 0 then 2 when 1 then 4 when 2 then 2 when 3 then 1 when 4 then 0 else 2 end::int as n_rows,
    page_id % 6 in (0, 1) as headed, page_id % 6 <> 1 as small from pages""")
def page_tables(spark, sf):
    rows = F.col("t.rows")
    found = F.get(html.tables_of(F.array("t"), "registration_table", "extracted"), F.lit(0))["rows"]
    headed = F.coalesce(html.header_has(rows, ["(?i)title of each class", "(?i)fee"]), F.lit(False))
    return _tabled(spark, sf).select("page_id", "t.classification", "t.kind", html.shelf_capacity(found).alias("capacity"), "text", F.size(rows).alias("n_rows"), headed.alias("headed"), html.shape_within(rows, 3, 4, 60).alias("small"))


@register("ignorable_rows", "select o_orderkey as k, o_orderkey % 3 <> 1 as ignorable from orders")
def ignorable_rows(spark, sf):
    row = F.expr("case o_orderkey % 3 when 0 then array('', null, 'page 3') when 1 then array('page 3', 'total') else array('') end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), html.row_ignorable(row, "^page [0-9]+$").alias("ignorable"))


# ---- items, notices, schedules

@register("item_bodies", "select o_orderkey as k, v.i::int as item_no, case v.i when 0 then 'before' when 1 then 'item101' else 'item801' end as item, case v.i when 0 then 'Cover ' || o_orderkey when 1 then 'Entry ' || o_orderkey || '.' else 'Other.' end as body from orders, (values (0), (1), (2)) v(i)")
def item_bodies(spark, sf):
    t = F.expr("concat('Cover ', o_orderkey, ' Item 1.01 Entry ', o_orderkey, '. ITEM 8. 01 Other. SIGNATURES signed')")
    return items.split_items(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), t.alias("t")), "k", "t", items.event_pattern(), until=items.SIGNATURE, before="before")


@register("schedule_items", "select o_orderkey as k, v.i::int as item_no, case v.i when 0 then 'before' else 'item' || case when v.i = 2 then '10' else '4' end end as item from orders, (values (0), (1), (2)) v(i)")
def schedule_items(spark, sf):
    t = F.expr("concat('Names ', o_orderkey, ' Item 4. Ownership of shares Item 10: Certification')")
    return items.split_items(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), t.alias("t")), "k", "t", items.schedule_pattern(items.SCHEDULE_G), before="before").drop("body")


@register("report_dates", "select o_orderkey as k, case when o_orderkey % 3 < 2 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders")
def report_dates(spark, sf):
    t = F.expr("case o_orderkey % 3 when 0 then concat('Date of Report (Date of earliest event reported): ', date_format(o_orderdate, 'MMMM d, yyyy')) when 1 then concat(date_format(o_orderdate, 'MMMM d, yyyy'), ' (Date of earliest event reported)') else 'No date of any report' end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), items.report_date(t).cast("string").alias("day"))


@register("schedule_tables", "select p_partkey as k, p_name as name, case when p_partkey % 2 = 0 then 'Utah' end as place, (100000 + p_partkey)::varchar || 'AB1' as cusip from part")
def schedule_tables(spark, sf):
    p = table(spark, sf, "part")
    row = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    rows = F.array(row("1.", "Name of reporting person", F.col("p_name")), row("3.", "SEC use only", ""), F.when(F.col("p_partkey") % 2 == 0, row("4.", "Citizenship", "Utah")).otherwise(row("4.", "Citizenship", "")))
    m = items.main_table(rows, ["name of reporting person", "sec use only", "citizenship"])
    number = items.cusip(F.concat(F.lit("CUSIP No. "), (100000 + F.col("p_partkey")).cast("string"), F.lit("AB1 (class)")))
    name = F.regexp_replace(F.try_element_at(m, F.lit("name of reporting person")), "\\s*3\\.$", "")
    return p.select(F.col("p_partkey").alias("k"), name.alias("name"), F.try_element_at(m, F.lit("citizenship")).alias("place"), number.alias("cusip"))


@register("effectiveness_notices", "select o_orderkey as k, case when o_orderkey % 2 = 0 then 'S-3' else 'EFFECT' end as for_form, strftime(o_orderdate, '%Y-%m-%d') as effective_date, '333-' || o_orderkey as file_number, lpad(o_custkey::varchar, 10, '0') as cik from orders")
def effectiveness_notices(spark, sf):
    x = F.expr("concat('<?xml version=\"1.0\"?><edgarSubmission><submissionType>EFFECT</submissionType><effectiveData><finalEffectivenessDispDate>', date_format(o_orderdate, 'yyyy-MM-dd'), '</finalEffectivenessDispDate>', if(o_orderkey % 2 = 0, '<form>S-3</form>', ''), '<filer><cik>', o_custkey, '</cik><fileNumber>333-', o_orderkey, '</fileNumber></filer></effectiveData></edgarSubmission>')")
    return _days(items.effectiveness(table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), x.alias("x")), "k", "x"), "effective_date")


# ---- commands

_SHELVES = "s as (select o_custkey as company_id, 'a' || (o_orderkey % 20) as accn, min(o_orderkey) as seq from orders where o_orderkey % 2 = 0 group by 1, 2)"
_OFFERS = f"{_SHELVES}, n as (select o_custkey as company_id, 'a' || (o_orderkey % 20) as accn, o_orderkey as seq from orders where o_orderkey % 3 = 0), h as (select n.*, s.seq < n.seq as ok from n left join s using (company_id, accn))"


def _commands(spark, sf, every):
    o = table(spark, sf, "orders").where(f"o_orderkey % {every} = 0")
    return o.selectExpr("o_custkey as company_id", "concat('a', o_orderkey % 20) as accn", "o_orderkey as seq")


def _offerings(spark, sf):
    none = spark.createDataFrame([], "company_id long, accn string, shelf_accn string, seq long")
    shelves = commands.add(spark.createDataFrame([], "company_id long, accn string, seq long"), _commands(spark, sf, 2), ["company_id", "accn"])
    return commands.add_offerings(none, _commands(spark, sf, 3), shelves)


@register("command_offerings", f"with {_OFFERS} select company_id, accn, accn as shelf_accn from h where ok group by 1, 2")
def command_offerings(spark, sf):
    return _offerings(spark, sf)[0].drop("seq")


@register("command_offerings_missed", f"with {_OFFERS} select seq, 'no shelf registration of this accn' as reason from h where not coalesce(ok, false)")
def command_offerings_missed(spark, sf):
    return _offerings(spark, sf)[1]


_REGISTERED = f"{_OFFERS}, f as (select company_id, accn, min(seq) as since from h where ok group by all), r as (select o_custkey as company_id, 'a' || (o_orderkey % 20) as offering_accn, o_orderkey % 4 as security_id, o_orderkey as seq from orders where o_orderkey % 5 = 0), z as (select r.*, coalesce(f.since < r.seq, false) as ok from r left join f on r.company_id = f.company_id and offering_accn = accn)"


def _registered(spark, sf):
    new = table(spark, sf, "orders").where("o_orderkey % 5 = 0").selectExpr("o_custkey as company_id", "concat('a', o_orderkey % 20) as offering_accn", "o_orderkey % 4 as security_id", "o_orderkey as seq")
    none = spark.createDataFrame([], "company_id long, offering_accn string, security_id long")
    return commands.add_registrations(none, new, _offerings(spark, sf)[0], ["company_id", "offering_accn", "security_id"])


@register("command_registrations", f"with {_REGISTERED} select distinct company_id, offering_accn, security_id::bigint as security_id from z where ok")
def command_registrations(spark, sf):
    return _registered(spark, sf)[0]


@register("command_registrations_missed", f"with {_REGISTERED} select seq, 'error: no shelf offering of this accn' as reason from z where not ok")
def command_registrations_missed(spark, sf):
    return _registered(spark, sf)[1]


_QUEUE = """q as (select o_orderkey as seq, ['company', 'shelf', 'offering', 'registration', 'resale', 'effect', 'shelf', 'offering', 'registration', 'other'][1 + (day(o_orderdate) % 10)] as op, o_custkey % 40 as company_id,
        case when o_custkey % 17 <> 0 then 'a' || (month(o_orderdate) % 4) end as accn, 'a' || (year(o_orderdate) % 4) as offering_accn, o_orderkey % 3 as security_id from orders),
    companies as (select *, row_number() over (partition by company_id order by seq) = 1 as is_first from q where op = 'company'),
    filed as (select q.*, q.accn is null as keyless, not exists (select 1 from companies c where c.company_id = q.company_id and c.seq < q.seq) as lacks from q where op in ('shelf', 'resale', 'effect')),
    shelves as (select *, row_number() over (partition by op, company_id, accn order by seq) = 1 as is_first from filed where not keyless and not lacks),
    offered as (select q.*, q.accn is null as keyless, not exists (select 1 from shelves s where s.op = 'shelf' and s.company_id = q.company_id and s.accn = q.accn and s.seq < q.seq) as lacks from q where op = 'offering'),
    offerings as (select *, row_number() over (partition by company_id, accn order by seq) = 1 as is_first from offered where not keyless and not lacks),
    registered as (select q.*, not exists (select 1 from offerings o where o.company_id = q.company_id and o.accn = q.offering_accn and o.seq < q.seq) as lacks from q where op = 'registration'),
    registrations as (select *, row_number() over (partition by company_id, offering_accn, security_id order by seq) = 1 as is_first from registered where not lacks),
    history as (select seq, op, 'rejected' as status, 'unknown op' as reason from q where op = 'other'
        union all select seq, op, case when is_first then 'applied' else 'present' end, null from (select seq, op, is_first from companies union all select seq, op, is_first from shelves union all select seq, op, is_first from offerings union all select seq, op, is_first from registrations)
        union all select seq, op, 'rejected', 'no key' from (select seq, op, keyless from filed union all select seq, op, keyless from offered) where keyless
        union all select seq, op, 'rejected', 'no company' from filed where lacks and not keyless
        union all select seq, op, 'rejected', 'no shelf registration of this accn' from offered where lacks and not keyless
        union all select seq, op, 'rejected', 'error: no shelf offering of this accn' from registered where lacks)"""


def _queue(spark, sf):
    kinds = "array('company', 'shelf', 'offering', 'registration', 'resale', 'effect', 'shelf', 'offering', 'registration', 'other')"
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as seq", f"{kinds}[day(o_orderdate) % 10] as op", "o_custkey % 40 as company_id", "case when o_custkey % 17 <> 0 then concat('a', month(o_orderdate) % 4) end as accn",
        "concat('a', year(o_orderdate) % 4) as offering_accn", "o_orderkey % 3 as security_id",
    )


@register("command_log", f"with {_QUEUE} select * from history")
def command_log(spark, sf):
    return command_log_.replay(_queue(spark, sf)).select("seq", "op", "status", "reason")


@register("command_log_tables", f"""with {_QUEUE} select 'offering' as op, company_id, accn, null::bigint as security_id from offerings where is_first
    union all select 'registration', company_id, offering_accn, security_id from registrations where is_first""")
def command_log_tables(spark, sf):
    history = command_log_.replay(_queue(spark, sf))
    offerings = command_log_.made(history, "offering", ["op", "company_id", "accn"]).withColumn("security_id", F.lit(None).cast("long"))
    return offerings.unionByName(command_log_.made(history, "registration", ["op", "company_id", "offering_accn", "security_id"]).withColumnRenamed("offering_accn", "accn"))


_SECURITIES = "u as (select s_nationkey::bigint as company_id, min(s_suppkey) as id, (s_suppkey % 4)::varchar as rate, s_name as name from supplier group by s_nationkey, s_suppkey, s_name), w as (select o_custkey % 25 as company_id, o_orderkey as seq, (o_orderkey % 4)::varchar as rate, o_totalprice as amount, strftime(o_orderdate, '%Y-%m-%d') as instant, 'a' || (o_orderkey % 20) as accn from orders), v as (select w.seq, min(u.id) as security_id from w join u on u.company_id = w.company_id and u.rate = w.rate group by 1), x as (select w.*, v.security_id from w left join v using (seq))"


def _securities(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("company_id"), F.col("s_suppkey").alias("id"), F.to_json(F.struct(F.col("s_name").alias("name"), (F.col("s_suppkey") % 4).cast("string").alias("interest_rate"))).alias("security_attributes"))
    new = table(spark, sf, "orders").selectExpr("o_custkey % 25 as company_id", "o_orderkey as seq", "map('interest_rate', cast(o_orderkey % 4 as string)) as attributes", "o_totalprice as amount", "cast(cast(o_orderdate as date) as string) as instant", "concat('a', o_orderkey % 20) as accn")
    return s, new


@register("command_outstanding", f"with {_SECURITIES} select distinct security_id, amount, instant from x where security_id is not null")
def command_outstanding(spark, sf):
    s, new = _securities(spark, sf)
    return commands.add_outstanding(spark.createDataFrame([], "security_id long, amount double, instant string"), new, s)[0]


@register("command_occurrences", f"with {_SECURITIES} select distinct security_id, accn from x where security_id is not null")
def command_occurrences(spark, sf):
    s, new = _securities(spark, sf)
    return commands.add_occurrences(spark.createDataFrame([], "security_id long, accn string"), new, s)[0]


@register("command_occurrences_missed", f"with {_SECURITIES} select seq, case when security_id is null then 'no security with these attributes' else 'already present' end as reason from x qualify security_id is null or row_number() over (partition by security_id, accn order by seq) > 1")
def command_occurrences_missed(spark, sf):
    s, new = _securities(spark, sf)
    return commands.add_occurrences(spark.createDataFrame([], "security_id long, accn string"), new, s)[1]


@register("command_links", "select o_custkey as company_id, 'u' || (o_orderkey % 30) as url, arg_min(o_orderpriority, o_orderkey) as form_type from orders group by 1, 2")
def command_links(spark, sf):
    new = table(spark, sf, "orders").selectExpr("o_custkey as company_id", "concat('u', o_orderkey % 30) as url", "o_orderpriority as form_type", "o_orderkey as seq")
    forms = spark.createDataFrame([("1-URGENT", "first")], "form_type string, category string")
    return commands.add_filing_links(spark.createDataFrame([], "company_id long, url string, form_type string"), new, forms)[0]


@register("command_link_forms", "select distinct o_orderpriority as form_type, case o_orderpriority when '1-URGENT' then 'first' else 'unspecified' end as category from orders union select '1-URGENT', 'first'")
def command_link_forms(spark, sf):
    new = table(spark, sf, "orders").selectExpr("o_custkey as company_id", "concat('u', o_orderkey % 30) as url", "o_orderpriority as form_type", "o_orderkey as seq")
    forms = spark.createDataFrame([("1-URGENT", "first")], "form_type string, category string")
    return commands.add_filing_links(spark.createDataFrame([], "company_id long, url string, form_type string"), new, forms)[1]


@register("command_companies", "select k, arg_min(v, seq) as v from (select 'c' || (o_orderkey % 500) as k, o_orderpriority as v, o_orderkey as seq from orders union all select 'c' || c_custkey, 'kept', -1 from customer where c_custkey < 100) group by 1")
def command_companies(spark, sf):
    old = table(spark, sf, "customer").where("c_custkey < 100").selectExpr("concat('c', c_custkey) as k", "'kept' as v")
    return commands.add(old, table(spark, sf, "orders").selectExpr("concat('c', o_orderkey % 500) as k", "o_orderpriority as v", "o_orderkey as seq"), ["k"])


@register("first_wins_union", "select o_custkey % 300 as k, case when bool_or(o_orderkey % 3 = 0) then 'old' else 'new' end as v from orders where o_orderkey % 3 < 2 group by 1")
def first_wins_union(spark, sf):
    o = table(spark, sf, "orders")
    old = o.where("o_orderkey % 3 = 0").selectExpr("o_custkey % 300 as k", "'old' as v").distinct()
    return state.insert_ignore(old, o.where("o_orderkey % 3 = 1").selectExpr("o_custkey % 300 as k", "'new' as v"), ["k"], [F.col("v")])


# ---- whole rounds

_FILED = """f as (select o_orderkey as k, o_custkey % 60 as file, o_orderdate::date as day, o_orderkey % 4 as kind from orders where o_orderkey % 6 > 0)"""


def _filings(spark, sf):
    o = table(spark, sf, "orders")
    page = "concat('<h1>PROSPECTUS</h1><p>We may sell from time to time in one or more offerings at an aggregate offering price of up to $', o_orderkey, ' million.</p>')"
    atm = "concat('<h1>PROSPECTUS SUPPLEMENT</h1><p>an at the market program, an aggregate offering price of up to $', o_orderkey, ' million</p>')"
    xml = "concat('<edgarSubmission><submissionType>EFFECT</submissionType><effectiveData><finalEffectivenessDispDate>', cast(cast(o_orderdate as date) as string), '</finalEffectivenessDispDate><filer><cik>1</cik><fileNumber>333-', o_custkey % 60, '</fileNumber></filer></effectiveData></edgarSubmission>')"
    filings = o.selectExpr("cast(o_orderkey as string) as accn", "case o_orderkey % 4 when 2 then 'EFFECT' when 3 then 'S-8' else 'S-3' end as form_type", "concat('333-', o_custkey % 60) as file_number", "cast(o_orderdate as date) as filing_date", "concat('x/', o_orderkey, case o_orderkey % 4 when 2 then '.xml' when 3 then '.pdf' else '.htm' end) as path", f"case o_orderkey % 4 when 0 then {page} when 1 then {atm} else {xml} end as content")
    history = o.where("o_orderkey % 6 = 0").selectExpr("cast(o_orderkey as string) as accession_number", "date'2020-01-01' as date_parsed")
    return extract.parse_new(filings, history, "all", "2023-01-01")


@register("round_shelves", f"with {_FILED} select k::varchar as accn, '333-' || file as file_number, k * 1e6 as capacity, strftime((day + {extract.SHELF_DAYS})::date, '%Y-%m-%d') as expiry from f where kind = 0")
def round_shelves(spark, sf):
    return _days(_filings(spark, sf)["shelf_registrations"].select("accn", "file_number", F.col("capacity").cast("double").alias("capacity"), "expiry"), "expiry")


@register("round_offerings", f"with {_FILED}, s as (select file, k from f where kind = 0 qualify row_number() over (partition by file order by day, k::varchar) = 1) select f.k::varchar as accn, s.k::varchar as shelf_accn, f.k * 1e6 as amount, strftime((f.day + {extract.OFFERING_DAYS})::date, '%Y-%m-%d') as end_date from f left join s using (file) where kind = 1")
def round_offerings(spark, sf):
    return _days(_filings(spark, sf)["shelf_offerings"].select("accn", "shelf_accn", F.col("anticipated_offering_amount").alias("amount"), "end_date"), "end_date")


@register("round_notices", f"with {_FILED} select k::varchar as accn, 'EFFECT' as for_form, strftime(day, '%Y-%m-%d') as effective_date, '333-' || file as file_number from f where kind = 2")
def round_notices(spark, sf):
    return _days(_filings(spark, sf)["effect_registrations"].drop("cik"), "effective_date")


@register("round_history", f"with {_FILED} select k::varchar as accession_number, case when kind is null then '2020-01-01' else '2023-01-01' end as date_parsed from (select k, kind from f where kind < 3 union all select o_orderkey, null from orders where o_orderkey % 6 = 0)")
def round_history(spark, sf):
    return _days(_filings(spark, sf)["filing_parse_history"], "date_parsed")


@register("round_unhandled", f"with {_FILED} select k::varchar as accn, 'S-8' as form_type from f where kind = 3")
def round_unhandled(spark, sf):
    return _filings(spark, sf)["unhandled"]


# ---- dependency trees: each order a sentence of its own

#: Orders of a customer as tokens of a sentence, in order of key; the token at place r hangs on that at r / 2, its part of speech and relation come from the order.
_TREE = """r as (select o_custkey as doc, o_orderkey as token, row_number() over (partition by o_custkey order by o_orderkey) as r,
        case o_orderpriority[1] when '1' then 'VERB' when '3' then 'ADV' when '5' then 'AUX' else 'NOUN' end as pos, case o_orderstatus when 'O' then 'nsubj' when 'F' then 'dobj' else 'advmod' end as dep from orders),
    e as (select a.doc, b.token as parent, a.token as child from r a join r b on a.doc = b.doc and b.r = a.r // 2 where a.r > 1),
    u as (select doc, parent as over_, child as under_ from e union select u.doc, e.parent, u.under_ from u join e on e.doc = u.doc and e.child = u.over_)"""


def _tree(spark, sf):
    o = table(spark, sf, "orders")
    tokens = o.select(
        F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("token"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("r"),
        F.expr("case substr(o_orderpriority, 1, 1) when '1' then 'VERB' when '3' then 'ADV' when '5' then 'AUX' else 'NOUN' end").alias("pos"), F.expr("case o_orderstatus when 'O' then 'nsubj' when 'F' then 'dobj' else 'advmod' end").alias("dep"),
    )
    heads = tokens.select("doc", F.col("r").alias("at"), F.col("token").alias("parent"))
    kids = tokens.where("r > 1").select("doc", F.floor(F.col("r") / 2).alias("at"), F.col("token").alias("child"))
    return tokens, kids.join(heads, ["doc", "at"]).select("doc", "parent", "child")


@register("dependency_pattern", f"""with recursive {_TREE}
    select n.doc, n.token as noun, v.token as verb, d.token as date, a.token as adverb from r n join e on e.doc = n.doc and e.child = n.token join r v on v.doc = n.doc and v.token = e.parent
        join u on u.doc = v.doc and u.over_ = v.token join r d on d.doc = u.doc and d.token = u.under_
        left join (select e.doc, e.parent, r.token from e join r on r.doc = e.doc and r.token = e.child where r.pos = 'ADV') a on a.doc = v.doc and a.parent = v.token
    where n.dep = 'nsubj' and v.pos in ('VERB', 'AUX') and d.pos = 'NOUN' and d.dep <> 'nsubj'""")
def dependency_pattern(spark, sf):
    tokens, edges = _tree(spark, sf)
    pattern = [{"id": "noun", "attrs": {"dep": ["nsubj", "nsubjpass"]}}, {"id": "verb", "attrs": {"pos": ["VERB", "AUX"]}, "of": "noun", "op": "<"}, {"id": "date", "attrs": {"pos": "NOUN"}, "not": {"dep": ["nsubj"]}, "of": "verb", "op": ">>"}, {"id": "adverb", "attrs": {"pos": "ADV"}, "of": "verb", "op": ">", "optional": True}]
    return graph.match_pattern(tokens, edges, pattern)


@register("path_groups", """
    with t as (select l_orderkey as doc, list({'token': 'w' || l_partkey, 'p': ['VERB', 'NOUN', 'NOUN', 'NOUN', 'NOUN', 'NOUN', 'ADP', 'ADP', 'ADJ', 'ADV', 'PUNCT'][1 + l_partkey % 11], 'd': ['nsubj', 'prep', 'amod', 'advmod', 'pobj'][1 + l_suppkey % 5]} order by l_linenumber, l_partkey, l_suppkey, l_quantity) as t from lineitem group by 1),
    c as (select *, len(list_filter(t, lambda x: x.p = 'VERB')) as verbs, len(list_filter(t, lambda x: x.p = 'NOUN')) as nouns, len(list_filter(t, lambda x: x.p = 'ADP')) as adps from t)
    select doc, case when verbs > 0 then 'verbal' when len(list_filter(t, lambda x: x.d = 'amod')) > 0 then 'amod' when nouns >= 2 and len(t) = nouns + adps then 'noun' when len(list_filter(t, lambda x: x.d = 'advmod')) > 0 then 'adverbal' else 'unknown' end as kind,
        array_to_string(list_transform(t[2:len(t) - 1], lambda x: x.token), ' ') as label, verbs::int as verbs, len(t) between 2 and 8 and len(list_filter(t, lambda x: x.p = 'PUNCT')) = 0 as valid,
        (len(t) - len(list_filter(t[2:len(t) - 1], lambda x: x.p = 'ADP')))::int as left from c""")
def path_groups(spark, sf):
    """The lines of an order as the tokens of a path, their parts of speech from the part, their relations from the supplier."""
    word = "struct(l_linenumber, l_partkey, l_suppkey, l_quantity, concat('w', l_partkey) as token, array('VERB', 'NOUN', 'NOUN', 'NOUN', 'NOUN', 'NOUN', 'ADP', 'ADP', 'ADJ', 'ADV', 'PUNCT')[l_partkey % 11] as pos, array('nsubj', 'prep', 'amod', 'advmod', 'pobj')[l_suppkey % 5] as dep)"
    # an order has a few lines
    path = F.transform("t", lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos"), x["dep"].alias("dep")))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.array_sort(F.collect_list(F.expr(word))).alias("t")).select("doc", path.alias("path"))
    c = F.col("path")
    return lines.select("doc", paths.group(c).alias("kind"), paths.relation_label(c).alias("label"), paths.counts(c)["verbs"].alias("verbs"), paths.valid(c).alias("valid"), F.size(paths.without(c, ["ADP"])).alias("left"))


@register("nearest_verbs", "select l_orderkey, arg_min(l_linenumber, l_suppkey * 10 + l_linenumber)::int as nearest, arg_max(l_linenumber, l_suppkey * 10 - l_linenumber)::int as farthest from lineitem group by 1")
def nearest_verbs(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber as verb", "l_suppkey as distance")
    near = paths.nearest_verb(d, "l_orderkey", "verb", "distance").selectExpr("l_orderkey", "verb as nearest")
    return near.join(paths.nearest_verb(d, "l_orderkey", "verb", "distance", farthest=True).selectExpr("l_orderkey", "verb as farthest"), "l_orderkey")


@register("verb_subjects", f"with recursive {_TREE} select e.doc, e.parent as verb, e.child as subject from e join r v on v.doc = e.doc and v.token = e.parent join r n on n.doc = e.doc and n.token = e.child where v.pos in ('VERB', 'AUX') and n.dep = 'nsubj'")
def verb_subjects(spark, sf):
    return paths.subjects(*_tree(spark, sf))


@register("phrases", f"""with recursive {_TREE}, h as (select * from r where pos in ('VERB', 'AUX') and exists (select 1 from e join r c on c.doc = e.doc and c.token = e.child where e.doc = r.doc and e.parent = r.token and c.dep = 'dobj')),
    s as (select doc, token as head, token from h union all select h.doc, h.token, u.under_ from h join u on u.doc = h.doc and u.over_ = h.token)
    select doc, head, min(token) as first, max(token) as last, count(*) as size from s group by 1, 2""")
def phrases(spark, sf):
    return paths.phrases(*_tree(spark, sf), ["VERB", "AUX"], ["dobj"])


_E = "e as (select 'r' || n_regionkey as parent, 'n' || n_nationkey as child from nation)"


@register("edges_changed", f"with {_E}, a as (select * from e union select 'n' || s_nationkey, 's' || s_suppkey from supplier) select * from a where parent not in ('n1', 'n2') and child not in ('n1', 'n2')")
def edges_changed(spark, sf):
    n = table(spark, sf, "nation").selectExpr("concat('r', n_regionkey) as parent", "concat('n', n_nationkey) as child")
    s = table(spark, sf, "supplier").selectExpr("concat('n', s_nationkey) as parent", "concat('s', s_suppkey) as child")
    gone = table(spark, sf, "nation").where("n_nationkey in (1, 2)").selectExpr("concat('n', n_nationkey) as node")
    return graph.remove_node(graph.add_edges(n, s.unionByName(n)), gone)


# ---- scalars and records

@register("required_keys", "select o_orderkey as k, o_orderkey % 3 = 0 as complete from orders")
def required_keys(spark, sf):
    record = F.expr("case o_orderkey % 3 when 0 then map('cik', '1', 'accn', '2') when 1 then map('cik', '1') else map('cik', '1', 'accn', cast(null as string)) end")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), predicates.has_required(record, ["cik", "accn"]).alias("complete"))


@register("number_words", "select p_partkey as k, case p_size % 4 when 0 then 0 when 1 then 7 when 2 then 12 end::double as value, case p_size % 3 when 0 then 1.0 when 1 then 30.0 else 365.25 end::double as days from part")
def number_words(spark, sf):
    word, unit = F.expr("case p_size % 4 when 0 then 'No' when 1 then 'seven' when 2 then 'twelfth' else 'many' end"), F.expr("case p_size % 3 when 0 then 'day' when 1 then 'Months' else 'year' end")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.number_word(word).alias("value"), S.unit_days(unit).alias("days"))


@register("intervals_of_days", "select p_partkey as k, p_size * 24 + 6 as hours from part")
def intervals_of_days(spark, sf):
    made = S.as_interval(F.col("p_size") + 0.25)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), (F.extract(F.lit("DAY"), made) * 24 + F.extract(F.lit("HOUR"), made)).cast("long").alias("hours"))


_ROMAN = "list_aggregate(list_transform(range(0, 4), lambda i: [['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'], ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'], ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'], ['', 'm', 'mm', 'mmm']][4 - i][(n // [1000, 100, 10, 1][i + 1]) % 10 + 1]), 'string_agg', '')"


@register("roman_numbers", f"with p as (select p_partkey as k, p_partkey % 3999 + 1 as n from part) select k, {_ROMAN} as roman from p")
def roman_numbers(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.roman(F.col("p_partkey") % 3999 + 1).alias("roman"))


@register("cases_swapped", "select p_partkey as k, 'No-Par-x' || upper(p_name[1]) || p_name[2:] as swapped from part".replace("'No-Par-x' || upper(p_name[1]) || p_name[2:]", "'no-Par-X-' || upper(p_name[1]) || p_name[2:]"))
def cases_swapped(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), S.swap_case_after(F.concat(F.lit("no-par-x-"), F.col("p_name")), "-").alias("swapped"))


@register("token_offsets", """
    with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) // 2 as mid from documents)
    select doc_id, case when t[mid + 1:mid + 1] in ('', ' ') then null else len(regexp_extract_all(t[1:mid + 1], '[^ ]+')) - 1 end::int as token, abs((doc_id % 5 + 3) - 10) / 2.0 as distance from d""")
def token_offsets(spark, sf):
    """The token that covers the middle character of each whole document."""
    d = table(spark, sf, "documents").withColumn("t", F.coalesce("text", F.lit("")))
    found = text.places(F.col("t"), "[^ ]+")
    d = d.select("doc_id", F.floor(F.length("t") / 2).cast("int").alias("at"), F.transform(found, lambda p: p["start"]).alias("starts"), F.transform(found, lambda p: p["end"] - p["start"]).alias("sizes"))
    return d.select("doc_id", S.char_to_token(F.col("starts"), F.col("sizes"), F.col("at")).alias("token"), S.span_distance(F.col("doc_id") % 5, F.lit(3), F.lit(4), F.lit(6)).alias("distance"))


@register("nested_fields", "select p_partkey as k, upper(p_name) || '/' || upper(p_brand) || '/' || upper(p_type) as fields from part")
def nested_fields(spark, sf):
    made = S.nested(F.array(F.array("p_name", "p_brand"), F.array("p_type")), F.upper)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.flatten(made), "/").alias("fields"))


@register("paths_and_dates", "select o_orderkey as k, case o_orderkey % 3 when 0 then '.htm' when 1 then '.xml' end as suffix, strftime((o_orderdate::date + 1095)::date, '%Y-%m-%d') as until, (date '2002-01-01' - o_orderdate::date)::int as days, round(abs(o_totalprice - 200000), 2) as apart, upper(o_orderpriority) as name from orders")
def paths_and_dates(spark, sf):
    path = F.expr("case o_orderkey % 3 when 0 then 'a.b/c.htm' when 1 then 'd.e.xml' else 'x.y/plain' end")
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), S.extension(path).alias("suffix"), F.date_add(day, 1095).cast("string").alias("until"), F.datediff(F.lit("2002-01-01").cast("date"), day).alias("days"), F.round(F.abs(F.col("o_totalprice") - 200000), 2).alias("apart"), F.upper("o_orderpriority").alias("name"))


@register("unparsed_in_order", "select o_orderkey as accn, row_number() over (order by o_orderdate, o_orderkey)::int as place from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)")
def unparsed_in_order(spark, sf):
    """Filings not parsed yet with their place by date: places come from day counts, so that no task sees all rows."""
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("accn"))
    left = predicates.absent(table(spark, sf, "orders").selectExpr("o_orderkey as accn", "o_orderdate as day"), done, ["accn"])
    return predicates.numbered(left, "day", ["accn"], "place")
