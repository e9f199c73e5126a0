import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import cash, commands, facts, graph, html, intervals, items, joins, predicates, state, text


def fact(end, val, fy=2020, start=None):
    return {"end": end, "val": val, "fy": fy} | ({"start": start} if start else {})


def companyfacts(spark):
    gaap = {
        "Cash": {"units": {"USD": [fact("2020-12-31", 5.0), fact("2020-12-31", 7.0)]}},
        "CashAndCashEquivalentsAtCarryingValue": {"units": {"USD": [fact("2020-12-31", 6.0), fact("2021-12-31", 9.0)]}},
        "cash": {"units": {"USD": [fact("2020-12-31", 99.0)]}},
        "NetCashProvidedByUsedInOperatingActivities": {"units": {"USD": [fact("2020-12-31", -10.0, 2020, "2020-01-01"), fact("2020-12-31", -20.0, 2021, "2020-01-01")]}},
        "NetCashProvidedByUsedInFinancingActivities": {"units": {"USD": [fact("2020-12-31", 1.0, 2020, "2020-01-01"), fact("2020-12-31", 2.0, 2021, "2020-01-01")]}},
    }
    dei = {"EntityCommonStockSharesOutstanding": {"units": {"shares": [fact("2020-12-31", 100.0)]}}}
    rows = [("0000000001", json.dumps({"facts": {"us-gaap": gaap, "dei": dei}})), ("0000000002", "not json")]
    return facts.explode_facts(spark.createDataFrame(rows, "cik string, j string"), "cik", "j")


def test_facts(spark):
    f = companyfacts(spark)
    assert {(str(r.end), r.val) for r in facts.net_cash(f, "cik").collect()} == {("2020-12-31", 7.0), ("2021-12-31", 9.0)}
    assert [r.val for r in facts.cash_flow(f, "cik", "operating").collect()] == [-20.0]
    assert [r.val for r in facts.cash_flow(f, "cik", "financing").collect()] == [1.0]
    assert [r.val for r in facts.outstanding_shares(f, "cik").collect()] == [100.0]
    assert facts.review_cash(f, "cik").count() == 2


def test_burn_and_runway(spark):
    d = datetime.date
    flows = spark.createDataFrame([(1, "operating", d(2020, 1, 1), d(2020, 1, 11), -100.0), (1, "investing", d(2020, 1, 1), d(2020, 1, 11), 50.0), (1, "financing", d(2020, 1, 1), d(2020, 1, 6), 5.0), (2, "financing", d(2020, 1, 1), d(2020, 1, 1), 5.0)], "company_id int, kind string, from_date date, to_date date, amount double")
    burn = cash.burn_rates(flows, "company_id")
    got = {r.company_id: r for r in burn.collect()}
    assert got[1].burn_rate_total == -5.0 and got[1].burn_rate_financing is None  # only the longest period of a start
    assert got[2].burn_rate_financing is None and got[2].burn_rate_total == 0.0  # no days, no rate; nothing known counts 0
    net = spark.createDataFrame([(1, d(2020, 1, 31), 1000.0), (2, d(2020, 1, 31), 10.0)], "company_id int, instant date, amount double")
    out = {r.company_id: r for r in cash.runway(net, burn, "company_id", "2020-02-10").collect()}
    assert out[1].days_of_cash == 190.0 and out[1].days_of_cash_date == d(2020, 2, 10)
    assert out[2].days_of_cash == float("inf")


def test_upserts(spark):
    old = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "k int, v int")
    new = spark.createDataFrame([(1, 4), (2, 6), (3, 7), (4, None)], "k int, v int")
    assert {tuple(r) for r in state.upsert_newer(old, new, ["k"], "v").collect()} == {(1, 5), (2, 6), (3, 7), (4, None)}
    guarded = state.upsert_if(old, new, ["k"], F.col("o.v") <= F.col("n.v"))
    assert {tuple(r) for r in guarded.collect()} == {(1, 5), (2, 6), (3, None), (4, None)}  # a null guard keeps the old row
    again = state.upsert_if(guarded, new, ["k"], F.col("o.v") <= F.col("n.v"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in guarded.collect()}
    assert {tuple(r) for r in state.insert_ignore(old, new.union(new), ["k"], [F.col("v")]).collect()} == {(1, 5), (2, 5), (3, None), (4, None)}
    commands = spark.createDataFrame([(1, "a", '{"k": 9, "v": 1}'), (2, "a", '{"k": 9, "v": 2}'), (3, "a", "{}"), (4, "zz", "{}"), (5, None, None)], "seq int, op string, payload string")
    tables, rejects = state.apply_commands(commands, {"a": old}, {"a": ["k"]})
    assert (9, 1) in {tuple(r) for r in tables["a"].collect()} and tables["a"].count() == 4
    assert {(r.seq, r.reason) for r in rejects.collect()} == {(3, "no key"), (4, "unknown op"), (5, "unknown op")}


def test_intervals(spark):
    rows = spark.createDataFrame([("x", a, b) for a, b in ((1, 3), (2, 5), (6, 8), (9, 11), (11, 14))], "k string, a int, b int")
    groups = intervals.overlap_groups(rows, ["k"], "a", "b")
    assert {(r.a, r.b, r.group_no) for r in groups.collect()} == {(1, 3, 1), (2, 5, 1), (9, 11, 2), (11, 14, 2)}
    assert {(r.a, r.b) for r in intervals.longest_per_group(groups, ["k"], "a", "b").collect()} == {(2, 5), (11, 14)}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "y")], "parent string, child string")
    assert {(r.leaf, tuple(r.path)) for r in graph.root_paths(edges).collect()} == {("c", ("a", "b", "c")), ("d", ("a", "d")), ("y", ("x", "y"))}
    assert {(r.child, r.origin) for r in graph.ultimate_origins(edges).collect()} == {("b", "a"), ("c", "a"), ("d", "a"), ("y", "x")}
    pairs = spark.createDataFrame([("c", "d"), ("c", "b")], "a string, b string")
    assert {(r.a, r.b, r.distance) for r in graph.tree_distance(edges, pairs).collect()} == {("c", "d", 4), ("c", "b", 2)}
    assert {(r.a, tuple(r.path)) for r in graph.shortest_paths(edges, pairs).collect()} == {("c", ("c", "b", "a", "d")), ("c", ("c", "b"))}


def test_dependency_pattern(spark):
    tokens = spark.createDataFrame([(1, 0, "expire", "VERB"), (1, 1, "warrant", "NOUN"), (1, 2, "on", "ADP"), (1, 3, "2025", "NUM")], "doc int, token int, lemma string, pos string")
    edges = spark.createDataFrame([(1, 0, 1), (1, 0, 2), (1, 2, 3)], "doc int, parent int, child int")
    pattern = [{"id": "noun", "attrs": {"pos": "NOUN"}}, {"id": "verb", "attrs": {"pos": "VERB"}, "of": "noun", "op": "<"}, {"id": "date", "attrs": {"pos": ["NUM"]}, "of": "verb", "op": ">>"}, {"id": "adv", "attrs": {"pos": "ADV"}, "of": "verb", "op": ">", "optional": True}]
    assert [tuple(r) for r in graph.match_pattern(tokens, edges, pattern).collect()] == [(1, 1, 0, 3, None)]


PAGE = """<html><head><title>T</title></head><body><p>PROSPECTUS</p><table><tr><td><a href="#u">Use of Proceeds</a></td><td>3</td></tr>
<tr><td><a href="#p">Plan of Distribution</a></td><td>9</td></tr></table><h2 id="u">Use of Proceeds</h2><p>We will use it.</p>
<h2 id="p">Plan of Distribution</h2><p>We sell <b>it</p><table><tr><td>&#8226;</td><td>one</td></tr><tr><td>&#8226;</td><td>two</td></tr></table></body></html>"""


def test_sections(spark):
    out = html.sections(PAGE)
    assert [s["title"] for s in out] == ["cover page", "Use of Proceeds", "Plan of Distribution"]
    assert out[1]["strategy"] == "toc_links" and "We will use it." in out[1]["text"]
    assert out[2]["tables"][0]["classification"] == "ul_bullet_points" and "• one" in out[2]["text"]
    assert html.sections(None) == [] or html.sections(None)[0]["text"] == ""
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, h string")
    got = html.split_sections(pages, "id", "h")
    assert got.where("id = 1").count() == 3
    assert {r.filing_no for r in html.filing_numbers(got, "id").where("id = 1").collect()} == {1}


def test_tables(spark):
    t = html.parse("<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td></td></tr></table>").tables[0]
    assert html.has_header(t)
    assert html.matrix(t) == [["A", "B"], ["1", "2", "3"], [""]]
    assert html.matrix(t, "separate")[0] == ["A", "", "B"]
    assert html.matrix(t, "merge")[1] == ["1 2", "3"]
    assert html.clean_matrix([["a", "", " b "], ["", "", ""], ["c", None, ""]]) == [["a", "b"], ["c", ""]]
    assert html.classify([["Title of each class to be registered", "Amount to be Registered", "Amount of registration fee"], ["x", "1", "2"]]) == "registration_table"
    assert html.classify([["Amount to be Registered", "Amount of registration fee"], ["1", "2"]]) == "unclassified"
    rows = [["Title", "Amount to be registered", "Proposed Maximum Aggregate Offering Price", "Fee"], ["Common", "10", "5", "1"], ["Total", "", "$75,000,000", "2"]]
    df = spark.createDataFrame([(rows,), (rows[:2],)], "r array<array<string>>").select(html.shelf_capacity(F.col("r")).alias("c"))
    assert [r.c for r in df.collect()] == ["75,000,000", "5"]


def test_items_and_notices(spark):
    t = "Head Item 1.01 Entry. Text one. Item 8.01 Other Events. Text two. SIGNATURES signed"
    docs = spark.createDataFrame([(1, t), (2, "none"), (3, None)], "id int, t string")
    got = items.split_items(docs, "id", "t", items.event_pattern(), until=items.SIGNATURE)
    assert [(r.id, r.item, r.body) for r in got.orderBy("item_no").collect()] == [(1, "item101", "Entry. Text one."), (1, "item801", "Other Events. Text two.")]
    day = spark.createDataFrame([("Date of Report (Date of earliest event reported): March 3, 2021",), ("March 3, 2021 (Date of report)",), ("x",)], "t string")
    assert [str(r.d) for r in day.select(items.report_date(F.col("t")).alias("d")).collect()] == ["2021-03-03", "2021-03-03", "None"]
    xml = "<?xml version='1.0'?><edgarSubmission><submissionType>EFFECT</submissionType><effectiveData><finalEffectivenessDispDate>2022-09-06</finalEffectivenessDispDate>{}<filer><cik>4411</cik><fileNumber>333-700123</fileNumber></filer></effectiveData></edgarSubmission>"
    notices = spark.createDataFrame([(1, xml.format("<form>S-1</form>")), (2, xml.format("")), (3, "<broken")], "id int, x string")
    got = {r.id: r for r in items.effectiveness(notices, "id", "x").collect()}
    assert tuple(got[1])[1:] == ("S-1", datetime.date(2022, 9, 6), "333-700123", "0000004411")
    assert got[2].for_form == "EFFECT" and got[3].for_form is None
    table = spark.createDataFrame([([["1.", "Name of reporting person", "Jane Roe"], ["3.", "SEC use only"], ["4.", "Citizenship", "Utah"]],)], "r array<array<string>>")
    found = table.select(items.main_table(F.col("r"), ["name of reporting person", "sec use only", "citizenship"]).alias("m")).first().m
    assert found["name of reporting person"].startswith("Jane Roe") and found["citizenship"] == "Utah"


def one(spark, f, *texts):
    return [r.y for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("y")).orderBy("i").collect()]


def test_long_numbers_called_cusip(spark):
    fields = ["CUSIP No. 1000000AB1 (class)", "CUSIP No. G3728V 109", "cusip number: 123456AB1", "No number of 1000000AB1", "CUSIP certificates", None]
    got = spark.createDataFrame([(i, f) for i, f in enumerate(fields)], "i int, f string").select("i", items.cusip(F.col("f")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == ["1000000AB1", "G3728V 109", "123456AB1", None, None, None]


def test_exercise_price_searches_once(spark):
    said = ["The exercise price of $1,234.50 per share.", "A conversion price equal to $2 million.", "The exercise price of $1.00 to $2.00.", "An exercise price of $1 and a conversion price of $2.", "None.", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.exercise_price(F.col("t"))["amount"].alias("p"))
    assert [r.p for r in df.orderBy("i").collect()] == [1234.5, 2e6, None, None, None, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("redem") == 1


def test_exercise_price_beside_an_explode(spark):
    df = spark.createDataFrame([("The exercise price of $3.50 per share of common stock.",)], "t string")
    got = df.select(F.explode(text.securities(F.col("t"))).alias("m"), text.exercise_price(F.col("t")).alias("p")).select("m", "p.amount", "p.currency").collect()
    assert [tuple(r) for r in got] == [("common stock", 3.5, "$")]


def test_flows_in_one_pass(spark):
    rnd = random.Random(8)
    tags = [t for _, t in facts.FLOW_TAGS.values()] + ["Cash", None]
    rows = [(rnd.randrange(3), rnd.choice(["us-gaap", "dei"]), rnd.choice(tags), rnd.choice(["a", None]), rnd.choice("xyz"), rnd.choice([1.0, 2.0, float("nan"), None]), rnd.choice([1, 2, None])) for _ in range(400)]
    df = spark.createDataFrame(rows, "c int, taxonomy string, tag string, start string, `end` string, val double, fy int")
    got = facts.cash_flows(df, "c")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = [(r.c, kind, r.start, r.end, str(r.val)) for kind in facts.FLOW_TAGS for r in facts.cash_flow(df, "c", kind).collect()]
    assert sorted([(r.c, r.kind, r.start, r.end, str(r.val)) for r in got.collect()], key=str) == sorted(want, key=str)


def test_alias_references_read_texts_once(spark):
    docs = spark.createDataFrame([(1, 'A (the "Bank-a") and B (the "Firm"). Bank-A pays the Firm; Bank-a rests.'), (2, 'C (the "Firm") is alone.'), (3, "No alias.")], "id int, t string")
    found = text.aliases(docs, "id", "t").localCheckpoint()
    got = text.alias_references(found, docs, "id", "t")
    assert sorted(map(tuple, got.collect())) == [(1, "Bank-a", 2), (1, "Firm", 1), (2, "Firm", 0)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_plain_tables_without_the_parser(monkeypatch):
    rnd = random.Random(9)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", '<td rowspan="2">', '<th colspan="3" rowspan="0">', "</td>", "a  b", " ", "x > y", '<td style="a" >', "</tr >"]
    odd = ["&amp;", "<b>", "<!-- c -->", "<TD>", "<td rowspan=2>", "<script>"]
    for n in range(600):
        page = "".join(rnd.choice(bits if n % 3 or rnd.random() < 0.8 else odd) for _ in range(rnd.randrange(25)))
        assert [t["rows"] for t in html.page_tables(page)] == [t["rows"] for t in html.parse(page).tables], page
    monkeypatch.setattr(html, "parse", None)
    assert [html.grid(t) for t in html.page_tables('<table><tr><td rowspan="2">k</td><td>1</td></tr><tr><td>2</td></tr></table>')] == [[["k", "1"], ["k", "2"]]]


def test_text(spark):
    assert one(spark, text.certainty, "Possibly the board can't agree.", "Holders should not rely on this.", "The board will meet.") == [("possibly", 0.3), ("should", 0.4), (None, 1.0)]
    assert one(spark, text.securities, "Listed are our Ordinary Shares, Class B common stock and Tranche 2 Warrants. A warrant certificate is none.") == [["Ordinary Shares", "Class B common stock", "Tranche 2 Warrants"]]
    prices = one(spark, text.exercise_price, "Each right has a redemption price of $7.25.", "with a conversion price per note equal to 7.25 $", "redemption prices of $3.00 and $4.00", "free of charge")
    assert [p and p.amount for p in prices] == [7.25, 7.25, None, None]
    dates = one(spark, lambda c: text.expiry_date(text.expiry(c)), "The option terminates on March 9, 2031.", "valid until the second anniversary of July 1, 2024", "at any time")
    assert [str(d) for d in dates] == ["2031-03-09", "2026-07-02", "None"]
    shares = one(spark, text.outstanding_shares, "On June 30, 2019, 1,250,400 shares of common stock were outstanding.", "77,000 shares of common stock issued and outstanding at June 30, 2019")
    assert [(s.amount, str(s.date)) for s in shares] == [(1250400.0, "2019-06-30"), (77000.0, "2019-06-30")]
    docs = spark.createDataFrame([(1, 'Acme Corp. ("Acme" or the "Issuer") sells. The Issuer and Issuer alike.')], "id int, t string")
    got = text.aliases(docs, "id", "t")
    assert {(r.alias, r.role) for r in got.collect()} == {("Acme", "component"), ("Issuer", "base")}
    assert text.alias_references(got, docs, "id", "t").first().n_references == 2
    assert one(spark, text.aggregate_offering, "an aggregate offering price of up to $12,500,000", "none") == [12.5e6, None]
    assert one(spark, text.split_enumeration, "namely: (i) first; (ii) second.") == [["(i) first", "(ii) second"]]
    rel = text.security_relations(spark.createDataFrame([(1, "On June 30, 2019 there were 2,000 shares of common stock outstanding.")], "id int, t string"), "id", "t")
    assert rel.where(text.is_outstanding_quantity(F.struct("negated", "date", "certainty", "amods", "amount"))).first().amount == 2000.0
    scored = spark.createDataFrame([("o1", "a", 1.5), ("o2", "a", 1.6), ("o1", "b", 1.3)], "o string, a string, s double")
    assert [tuple(r) for r in text.best_alias(scored, "o", "a", "s").collect()] == [("o2", "a", 1.6)]


def test_places_and_aliases(spark):
    assert one(spark, lambda c: text.places(c, "[a-z]+"), "ab 1 c", "", None, "1") == [[(0, 2, "ab"), (5, 6, "c")], [], None, []]
    t = 'Firm (the "Seller") and Bank (the "Seller Trust") agree. Seller Trust pays Seller; the Resellers do not. A (the "Seller") note.'
    docs = spark.createDataFrame([(1, t), (2, None), (3, "no alias")], "id int, t string")
    found = text.alias_places(text.aliases(docs, "id", "t"), docs, "id", "t").collect()
    assert sorted((r.alias, t[r.start : r.end]) for r in found) == [("Seller", "Seller"), ("Seller Trust", "Seller Trust")]
    docs = spark.createDataFrame([(1, "We sell Pre-Funded Warrants. Each pre-funded warrant and PRE-FUNDED WARRANTS count."), (2, None)], "id int, t string")
    assert text.second_pass(docs, "id", "t").count() == 3


def brute_longest(spans):
    kept = []
    for a, b in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[1])):
        if all(b <= x or y <= a for x, y in kept):
            kept.append((a, b))
    return sorted(kept)


def test_keep_longest(spark):
    rng = random.Random(3)
    rows = [(i, [(a, a + rng.randint(1, 9)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 9)))]) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, s array<struct<start int, end int>>")
    got = {r.id: [tuple(x) for x in r.k] for r in df.select("id", intervals.keep_longest(F.col("s")).alias("k")).collect()}
    assert got == {i: brute_longest(s) for i, s in rows}


def test_deep_and_cyclic_graphs(spark):
    chain = spark.range(999).selectExpr("concat('n', id) as parent", "concat('n', id + 1) as child")
    up = graph.ancestors(chain)
    assert up.count() == 999 * 1000 // 2 and up.agg(F.max("depth")).first()[0] == 999
    assert len(graph.root_paths(chain).first().path) == 1000
    assert graph.ultimate_origins(chain).where("origin <> 'n0'").count() == 0
    pairs = spark.createDataFrame([("n10", "n900"), ("n5", "n5")], "a string, b string")
    assert {(r.a, len(r.path), r.path[0], r.path[-1]) for r in graph.shortest_paths(chain, pairs).collect()} == {("n10", 891, "n10", "n900"), ("n5", 1, "n5", "n5")}
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("r", "a"), (None, "x"), ("x", None), ("a", "b")], "parent string, child string")
    assert {(r.child, r.ancestor) for r in graph.ancestors(ring).collect()} == {(x, y) for x in "abcd" for y in "abcr" if x != y}
    assert [(r.leaf, r.path) for r in graph.root_paths(ring).collect()] == [("d", ["r", "a", "b", "c", "d"])]
    assert {r.child for r in graph.ultimate_origins(ring).where("origin = 'r'").collect()} == {*"abcd"}
    wide = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")], "parent string, child string")
    assert sorted(r.path for r in graph.root_paths(wide).collect()) == [[*"abde"], [*"acde"]]
    empty = wide.limit(0)
    assert graph.ancestors(empty).count() == graph.root_paths(empty).count() == 0


def test_many_edges(spark):
    """Two million edges: a forest of trees of three levels."""
    edges = spark.range(2_000_000).selectExpr("if(id < 1000, -1 - id % 10, (id - 1000) % 1000) as parent", "id as child")
    origins = graph.ultimate_origins(edges)
    assert origins.count() == 2_000_000 and origins.where("origin >= 0").count() == 0


def test_command_rules(spark):
    none = lambda s: spark.createDataFrame([], s)
    shelves = spark.createDataFrame([(1, "a", 5), (1, "b", 1)], "company_id long, accn string, seq long")
    new = spark.createDataFrame([(1, "a", 3, "clash"), (1, "a", 7, ""), (1, "a", 8, ""), (1, "b", 2, ""), (2, "b", 9, ""), (None, None, 4, "")], "company_id long, accn string, seq long, reason string")
    table, missed = commands.add_offerings(none("company_id long, accn string, shelf_accn string"), new, shelves)
    assert sorted(map(tuple, table.collect())) == [(1, "a", "a"), (1, "b", "b")]
    assert sorted(r.seq for r in missed.collect()) == [3, 4, 9]
    secu = spark.createDataFrame([(1, 10, '{"name": "w", "right": "Call"}'), (1, 11, '{"name": "w", "right": "Put"}'), (1, 12, "broken"), (1, 13, None)], "company_id long, id long, security_attributes string")
    facts_ = spark.createDataFrame([(1, 1, {"name": "w"}, 5.0, "d"), (1, 2, {"name": "w", "right": "Put"}, 6.0, "d"), (1, 3, {"name": "x"}, 7.0, "d"), (1, 4, {}, 1.0, "d"), (1, 5, None, 1.0, "d"), (1, 6, {"name": "w"}, 5.0, "d")], "company_id long, seq long, attributes map<string,string>, amount double, instant string")
    held, missed = commands.add_outstanding(none("security_id long, amount double, instant string"), facts_, secu)
    assert sorted(map(tuple, held.collect())) == [(10, 5.0, "d"), (11, 6.0, "d")] and sorted(r.seq for r in missed.collect()) == [3, 4, 5]
    seen, missed = commands.add_occurrences(spark.createDataFrame([(11, "f")], "security_id long, accn string"), facts_.withColumn("accn", F.lit("f")), secu)
    assert sorted(map(tuple, seen.collect())) == [(10, "f"), (11, "f")]
    assert {r.seq: r.reason for r in missed.collect()} == {2: "already present", 6: "already present", **dict.fromkeys((3, 4, 5), "no security with these attributes")}


def test_places_by_date(spark):
    rows = spark.createDataFrame([(3, "b"), (1, "b"), (2, "a"), (9, "c")], "k int, d string")
    assert {r.k: r.n for r in predicates.numbered(rows, "d", ["k"], "n").collect()} == {2: 1, 1: 2, 3: 3, 9: 4}


def test_front_pages(spark):
    page = "<title>T</title><p>Form S-3</p><p>EXPLANATORY NOTE</p><p>Two parts.</p>" + PAGE
    out = html.sections(page)
    assert [s["title"] for s in out] == ["front page", "explanatory note", "cover page", "Use of Proceeds", "Plan of Distribution"]
    assert out[0]["text"] == "Form S-3" and out[1]["text"] == "EXPLANATORY NOTE Two parts."
    styled = html.parse("<center><b>HEAD</b></center><p style='text-align:center'><span style='font-weight:700'>Sub</span> plain</p><div hidden><script>x</script></div>")
    assert [(p["text"], p["bold"], p["centered"]) for p in styled.pieces] == [("HEAD", True, True), ("Sub", True, True), ("plain", False, True)]


@pytest.mark.parametrize(("written", "value"), [("7,5", 7.5), ("7,55", 7.55), ("7,1234", 71234.0), ("100,000", 100000.0), ("2,500,000.75", 2500000.75), ("1.000,5", None), ("12", 12.0), ("x", None)])
def test_numbers(spark, written, value):
    from factloom.functions import scalars

    assert one(spark, scalars.american_number, written) == [value]


def test_joins(spark):
    p = spark.createDataFrame([(1,), (2,)], "k int")
    c = spark.createDataFrame([(1, "b"), (1, "a")], "fk int, v string")
    got = {r.k: [x.v for x in r.kids] for r in joins.with_children(p, "k", {"kids": (c, "fk")}).collect()}
    assert got == {1: ["a", "b"], 2: []}
    either = joins.join_either(p, spark.createDataFrame([(1, 2), (2, 2)], "x int, y int"), "k", "x", "y")
    assert either.count() == 3
    twice = joins.join_either(p, spark.createDataFrame([(1, 5), (1, 5), (5, 1), (1, 1), (None, 2)], "x int, y int"), "k", "x", "y")
    assert sorted(r.k for r in twice.collect()) == [1, 1, 1, 1, 2]
