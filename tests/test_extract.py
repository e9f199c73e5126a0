import datetime

from pyspark.sql import functions as F

from factloom.operators import extract, paths

PAGE = """<html><body><p>PROSPECTUS</p><p>We may offer from time to time in one or more offerings securities with an aggregate offering price of up to $40,000,000.</p>
<table><tr><td><a href="#u">Use of Proceeds</a></td></tr><tr><td><a href="#p">Plan of Distribution</a></td></tr></table>
<h2 id="u">Use of Proceeds</h2><p>The exercise price of the Series A warrants is $2.50. The Series A warrants expire on March 9, 2031.
As of June 30, 2019 there were 1,000 shares of common stock outstanding.</p><h2 id="p">Plan of Distribution</h2><p>x</p></body></html>"""
ATM = "<html><body><h1>PROSPECTUS SUPPLEMENT</h1><p>an at the market offering with an aggregate offering price of up to $9 million</p></body></html>"
XML = "<edgarSubmission><submissionType>EFFECT</submissionType><effectiveData><finalEffectivenessDispDate>2021-04-07</finalEffectivenessDispDate><form>S-3</form><filer><cik>77</cik><fileNumber>333-1</fileNumber></filer></effectiveData></edgarSubmission>"


def test_round(spark):
    d = datetime.date
    rows = [("a1", "S-3", "333-1", d(2020, 3, 4), "x/a1.htm", PAGE), ("a2", "S-3", "333-1", d(2020, 8, 1), "x/a2.htm", ATM), ("a3", "EFFECT", "333-1", d(2021, 4, 8), "x/a3.xml", XML), ("a4", "S-3", "9", d(2020, 1, 1), "x/a4.htm", PAGE), ("a5", "EFFECT", "1", d(2020, 1, 1), "x/a5.pdf", "")]
    filings = spark.createDataFrame(rows, "accn string, form_type string, file_number string, filing_date date, path string, content string")
    history = spark.createDataFrame([("a4", d(2020, 2, 2))], "accession_number string, date_parsed date")
    out = extract.parse_new(filings, history, ["S-3", "EFFECT"], "2023-01-01")
    shelf = out["shelf_registrations"].collect()
    assert [(r.accn, r.capacity, r.expiry) for r in shelf] == [("a1", "4.0E7", d(2020, 3, 4) + datetime.timedelta(extract.SHELF_DAYS))]
    atm = out["shelf_offerings"].first()
    assert (atm.accn, atm.shelf_accn, atm.anticipated_offering_amount, atm.end_date) == ("a2", "a1", 9e6, d(2023, 8, 1))
    assert out["effect_registrations"].first().effective_date == d(2021, 4, 7)
    names = {(r.security_name, r.security_type) for r in out["securities"].collect()}
    assert names == {("series a warrant", "Warrant"), ("common stock", "CommonShare")}
    assert out["securities_outstanding"].first().amount == 1000.0
    assert [r.accn for r in out["unhandled"].collect()] == ["a5"]
    assert sorted(r.accession_number for r in out["filing_parse_history"].collect()) == ["a1", "a2", "a3", "a4"]
    again = extract.parse_new(filings, out["filing_parse_history"], "all", "2023-01-02")
    assert again["shelf_registrations"].count() == 0


def test_paths(spark):
    path = [("warrants", "NOUN", "nsubj"), ("expire", "VERB", "ROOT"), ("on", "ADP", "prep"), ("2025", "NUM", "pobj")]
    df = spark.createDataFrame([(path,), ([("a", "NOUN", "x"), ("of", "ADP", "prep"), ("b", "NOUN", "pobj")],)], "p array<struct<token string, pos string, dep string>>")
    p = F.col("p")
    got = df.select(paths.group(p).alias("g"), paths.relation_label(p).alias("l"), paths.counts(p)["verbs"].alias("v"), paths.valid(p).alias("ok"), F.size(paths.without(p, ["ADP"])).alias("n")).collect()
    assert [tuple(r) for r in got] == [("verbal", "expire on", 1, True, 3), ("noun", "of", 0, True, 2)]
    near = spark.createDataFrame([("t", "v1", 3), ("t", "v2", 2)], "t string, v string, d int")
    assert paths.nearest_verb(near, "t", "v", "d").first().v == "v2"


def test_verb_groups(spark):
    from pyspark.sql import functions as F

    from factloom.operators import text

    said = "We may not sell, but they can't have been paid; nor will it also expire on May 3. Never mind. It is effective."
    rows = spark.createDataFrame([(said,), (None,), ("",)], "s string").select(text.verb_groups(F.col("s")).alias("g")).collect()
    assert [(g.group, g.verb, g.negated, g.marker, g.level) for g in rows[0].g] == [("may not", "sell", True, "may", 0.2), ("can not have been", "paid", True, "can", 0.3), ("is", "effective", False, None, 1.0)]
    assert not rows[2].g


def test_phrases_by_walking(spark):
    import random

    from factloom.operators import paths

    rnd = random.Random(51)
    tokens, edges = [], []
    for doc in range(20):
        for t in range(1, 13):
            tokens.append((doc, t, rnd.choice(["ADP", "VERB", "NOUN"]), rnd.choice(["dobj", "prep", "nsubj"])))
            if t > 1:
                edges.append((doc, rnd.randrange(1, t), t))
    below = {}
    for doc, a, b in edges:
        below.setdefault((doc, a), []).append(b)

    def under(doc, t):
        return [t, *[x for c in below.get((doc, t), ()) for x in under(doc, c)]]

    dep = {(d, t): r for d, t, _, r in tokens}
    for pos, children in ((["ADP"], None), (["VERB"], ["dobj"])):
        want = []
        for d, t, p, _ in tokens:
            if p in pos and (children is None or any(dep[d, c] in children for c in below.get((d, t), ()))):
                found = under(d, t)
                want.append((d, t, min(found), max(found), len(found)))
        got = paths.phrases(spark.createDataFrame(tokens, "doc long, token long, pos string, dep string"), spark.createDataFrame(edges, "doc long, parent long, child long"), pos, children)
        assert sorted(map(tuple, got.select("doc", "head", "first", "last", "size").collect())) == sorted(want)
