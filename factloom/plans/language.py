"""Registered plans on prospectus language. Sentences are written from the columns of orders, so each SQL twin knows what must be read from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import coreference, extract, intervals, text
from . import register, table

#: Columns that sentences use, the same in both engines: k, day (date), n (a count), p (a price of quarter dollars).
_BASE = "o_orderkey as k, cast(o_orderdate as date) as day, 1000 + 37 * o_orderkey as n, (o_orderkey % 400) * 0.25 + 0.5 as p"
_SQL = f"o as (select {_BASE.replace('0.25 + 0.5', '0.25::double + 0.5::double')} from orders)"
_DAY, _N, _P = "date_format(day, 'MMMM d, yyyy')", "format_number(n, 0)", "format_string('%.2f', p)"


def _said(spark, sf, **parts: str):
    """Orders as texts: k and a column for each expression."""
    o = table(spark, sf, "orders").selectExpr(*[x.strip() for x in ("o_orderkey as k", "cast(o_orderdate as date) as day", "1000 + 37 * o_orderkey as n", "cast((o_orderkey % 400) * 0.25 + 0.5 as double) as p")])
    names = {"DAY": _DAY, "NUM": _N, "PRICE": _P}
    for name, body in parts.items():
        for mark, made in names.items():
            body = body.replace("{" + mark + "}", f"', {made}, '")
        o = o.withColumn(name, F.expr(body))
    return o


def _case(by: str, *bodies: str) -> str:
    """A text by k modulo a number: the bodies in turn, {DAY}, {NUM} and {PRICE} filled in."""
    return f"case k % {len(bodies)} " + " ".join(f"when {i} then concat('{b}')" for i, b in enumerate(bodies)) + " end" if by == "k" else by


def _date(c):
    return c.cast("string")


@register("outstanding_by_phrase", f"with {_SQL} select k, case when k % 4 < 3 then n end::double as amount, case when k % 4 < 3 then strftime(day, '%Y-%m-%d') end as day from o")
def outstanding_by_phrase(spark, sf):
    t = _case("k", "As of {DAY}, {NUM} shares of common stock were outstanding.", "There were {NUM} shares of common stock issued and outstanding as of {DAY}.", "The common stock outstanding on {DAY} was {NUM} shares.", "Nothing is stated on {DAY}.")
    found = text.outstanding_shares(F.col("t"))
    return _said(spark, sf, t=t).select("k", found["amount"].alias("amount"), _date(found["date"]).alias("day"))


@register("exercise_prices", f"with {_SQL} select k, case when k % 4 < 2 then p end as price from o")
def exercise_prices(spark, sf):
    t = _case("k", "The warrants have an exercise price of ${PRICE} per share.", "They carry a conversion price per share equal to ${PRICE}.", "The exercise price of ${PRICE} to $900.00 depends on the date.", "No price is stated.")
    return _said(spark, sf, t=t).select("k", text.exercise_price(F.col("t"))["amount"].alias("price"))


@register("expiry_dates", f"with {_SQL} select k, strftime(case k % 3 when 0 then day when 1 then day + (round((k % 2 + 3) * 365.25)::int) end::date, '%Y-%m-%d') as expires from o")
def expiry_dates(spark, sf):
    t = "case k % 3 when 0 then concat('The warrants expire on {DAY}.') when 1 then concat('They may be exercised until the ', if(k % 2 = 0, 'third', 'fourth'), ' anniversary of {DAY}.') else 'They do not lapse.' end"
    return _said(spark, sf, t=t).select("k", _date(text.expiry_date(text.expiry(F.col("t")))).alias("expires"))


@register("date_relations", f"with {_SQL} select k, case k % 3 when 0 then 'expiry' when 1 then 'exercise' end as kind, strftime(day, '%Y-%m-%d') as day, case k % 3 when 2 then 14.0 else 0.0 end as days from o")
def date_relations(spark, sf):
    t = _case("k", "The notes expire at noon on {DAY}.", "The rights are exercisable from {DAY}.", "Payment is due two weeks after {DAY}.")
    r = text.date_relation(F.col("t"))
    return _said(spark, sf, t=t).select("k", r["kind"].alias("kind"), _date(r["date"]).alias("day"), F.aggregate(r["days"], F.lit(0.0), lambda a, x: a + x).alias("days"))


@register("unit_prices", f"with {_SQL} select k, case when k % 3 < 2 then p end as price, case k % 2 when 0 then 'series b warrant' else 'preferred stock' end as source from o")
def unit_prices(spark, sf):
    t = "concat(case k % 3 when 0 then concat('We sell units at a price per unit of ${PRICE}') when 1 then concat('We sell at a public offering price of ${PRICE}') else 'We sell units' end, ', with shares issuable upon ', if(k % 2 = 0, 'the exercise of the Series B Warrants', 'conversion of our preferred shares'), '.')".replace("preferred shares", "preferred stock")
    c = F.col("t")
    return _said(spark, sf, t=t).select("k", text.at_price(c).alias("price"), text.source_of(c).alias("source"))


@register("quantities", f"with {_SQL} select k, n::double as amount, case k % 2 when 0 then 'COUNT' else 'MONEY' end as unit, case k % 2 when 0 then 'common stock' else 'debt security' end as security from o")
def quantities(spark, sf):
    t = "if(k % 2 = 0, concat('We offer {NUM} shares of our common stock.'), concat('We offer ${NUM} of debt securities.'))"
    rows = _said(spark, sf, t=t).select("k", F.explode(text.security_quantities(F.col("t"))).alias("q"))
    return rows.select("k", "q.amount", "q.unit", "q.security")


@register("security_relations", f"with {_SQL} select k, 'common stock' as secu_key, n::double as amount, 'COUNT' as unit, strftime(day, '%Y-%m-%d') as day, false as negated, 1.0 as certainty from o where k % 4 = 0")
def security_relations(spark, sf):
    t = _case("k", "On {DAY} we had {NUM} shares of common stock outstanding. Nothing else is known.", "On {DAY} there were not {NUM} shares of common stock outstanding.", "On {DAY} we may have {NUM} shares of common stock outstanding.", "We had {NUM} shares of common stock outstanding.")
    rows = text.security_relations(_said(spark, sf, t=t).select("k", "t"), "k", "t").where(text.is_outstanding_quantity(F.struct("negated", "date", "certainty", "amods", "amount")))
    return rows.select("k", "secu_key", "amount", "unit", _date(F.col("date")).alias("day"), "negated", "certainty")


@register("security_mentions", f"with {_SQL} select k, 'series a warrant' as secu_key, 2::bigint as mentions, p as exercise_price, strftime(day, '%Y-%m-%d') as expires from o union all select k, 'common stock', 1 + k % 2, null, null from o")
def security_mentions(spark, sf):
    t = "concat('The exercise price of the Series A Warrants is ${PRICE}. Our common stock is listed. ', if(k % 2 = 1, 'Common stock is traded daily. ', ''), 'The Series A warrants expire on {DAY}.')"
    found = text.security_objects(_said(spark, sf, t=t).select("k", "t"), "k", "t")
    return found.select("k", "secu_key", "mentions", "exercise_price", _date(F.col("expiry_date")).alias("expires"))


_MODALS = ("must", "may", "should", "could", "perhaps")


@register("certainty", f"with {_SQL} select k, case k % 7 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_MODALS)) + " end as marker, case k % 7 " + " ".join(f"when {i} then {text.CERTAINTY[w]}" for i, w in enumerate(_MODALS)) + " else 1.0 end::double as level, k % 7 in (1, 6) as negated from o")
def certainty(spark, sf):
    t = _case("k", "We must sell shares.", "We may not sell shares.", "Holders should read this.", "Could we sell them?", "Perhaps we sell on May 5, 2021.", "We will sell on May 5, 2021.", "We never sold them.")
    c = text.certainty(F.col("t"))
    return _said(spark, sf, t=t).select("k", c["marker"].alias("marker"), c["level"].alias("level"), text.negated(F.col("t")).alias("negated"))


_MERGED = r"(?i)par\s+value|[0-9]+[a-z]?(?:\([a-z0-9]{1,4}\))+|\([a-z0-9]{1,4}\)|\$|[0-9][0-9,]*(?:\.[0-9]+)?|[0-9A-Za-z_''-]+|[^0-9A-Za-z_\s]"


@register("merged_tokens", f"""with t as (select doc_id, regexp_extract_all(coalesce(text, '') || ' par value, Rule 4' || doc_id || '(a)(1), (iv).', '{_MERGED}') as t from documents)
    select doc_id, len(t)::int as n, md5(array_to_string(t, ' ')) as tokens, 'Rule 4' || doc_id || '(a)(1)' as act from t""")
def merged_tokens(spark, sf):
    """The tokens of whole documents that end in a reference to the law."""
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" par value, Rule 4"), F.col("doc_id").cast("string"), F.lit("(a)(1), (iv)."))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    tokens = text.merged_tokens(F.col("t"))
    return d.select("doc_id", F.size(tokens).alias("n"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens"), F.element_at(text.act_references(F.col("t")), -1).alias("act"))


@register("entity_families", f"with {_SQL} select k, 'Loan ' || chr((65 + k % 26)::int) || ' Purchase Agreement' as contract, (k % 2)::int as placements, ['these shares'] = ['these shares'] as refers, 'exercise price' as attribute from o")
def entity_families(spark, sf):
    t = "concat('under the Loan ', chr(65 + k % 26), ' Purchase Agreement ', if(k % 2 = 1, 'in a private placement', 'in public'), ' these shares have an exercise price')"
    c = F.col("t")
    first = lambda found: F.get(found, F.lit(0))
    return _said(spark, sf, t=t).select("k", first(text.contracts(c)).alias("contract"), F.size(text.placements(c)).alias("placements"), (text.security_refs(c) == F.array(F.lit("these shares"))).alias("refers"), first(text.security_attributes(c)).alias("attribute"))


@register("entities_added", """
    with s as (select o_orderkey as k, o_orderkey % 5 as a, 1 + o_custkey % 6 as la, 1 + (o_orderkey // 5) % 3 as g, 1 + (o_custkey // 6) % 6 as lb, (o_orderkey // 7) % 14 as s, 1 + (o_custkey // 3) % 9 as ls from orders),
    m as (select *, a + la + g as b, s < a + la and a < s + ls as m1, s < a + la + g + lb and a + la + g < s + ls as m2 from s),
    w as (select *, (not m1 or ls >= la) and (not m2 or ls >= lb) as wins from m)
    select k, array_to_string(list_sort(list_filter([case when not wins or not m1 then 'DATE:' || a || '-' || (a + la) end, case when not wins or not m2 then 'MONEY:' || b || '-' || (b + lb) end, case when wins then 'SECU:' || s || '-' || (s + ls) end], lambda x: x is not null)), ',') as spans from w""")
def entities_added(spark, sf):
    """Two old spans and a new one whose places and lengths come from the order."""
    o = table(spark, sf, "orders").selectExpr("o_orderkey as k", "o_orderkey % 5 as a", "1 + o_custkey % 6 as la", "1 + (o_orderkey div 5) % 3 as g", "1 + (o_custkey div 6) % 6 as lb", "(o_orderkey div 7) % 14 as s", "1 + (o_custkey div 3) % 9 as ls")
    span = lambda a, b, label: F.struct(F.expr(a).alias("start"), F.expr(b).alias("end"), F.lit(label).alias("label"))
    done = text.add_entities(F.array(span("a", "a + la", "DATE"), span("a + la + g", "a + la + g + lb", "MONEY")), F.array(span("s", "s + ls", "SECU")), ["LAW"])
    named = F.transform(done, lambda x: F.concat(x["label"], F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return o.select("k", F.array_join(F.array_sort(named), ",").alias("spans"))


@register("issuable_phrases", f"with {_SQL} select k, (k % 3)::int as n, case when k % 2 = 0 then 'This prospectus relates to the resale of shares.' end as relates, case when k % 5 < 4 then (1 + k % 90) * 1e6 end::double as offering from o")
def issuable_phrases(spark, sf):
    t = "concat(repeat(concat('We hold {NUM} shares of common stock issuable upon the exercise of outstanding warrants. '), int(k % 3)), if(k % 2 = 0, 'This prospectus relates to the resale of shares. ', ''), if(k % 5 < 4, concat('It has an aggregate offering price of up to $', 1 + k % 90, ' million.'), 'It has an aggregate offering price of $1 or an aggregate offering amount of $2.'))"
    c = F.col("t")
    return _said(spark, sf, t=t).select("k", F.size(text.issuable(c)).alias("n"), text.relates_to(c).alias("relates"), text.aggregate_offering(c).alias("offering"))


_ALIASED = "concat('Firm ', k, ' Inc. (\"Firm-one\", and with its branch, the \"Company\") and Bank ', k, ' (the \"Bank-a\") agree. ', repeat('The Company pays Bank-A. ', int(k % 3)), 'Companyhood is no match, nor is My-Company.')"


@register("quoted_aliases", f"with {_SQL} select k, 0::int as paren_no, 0::int as alias_no, 'Firm-one' as alias, 'component' as role from o union all select k, 0, 1, 'Company', 'base' from o union all select k, 1, 0, 'Bank-a', 'base' from o")
def quoted_aliases(spark, sf):
    return text.aliases(_said(spark, sf, t=_ALIASED).select("k", "t"), "k", "t").drop("paren")


@register("alias_references", f"with {_SQL} select k, 'Company' as alias, k % 3 as n_references from o union all select k, 'Bank-a', k % 3 from o")
def alias_references(spark, sf):
    d = _said(spark, sf, t=_ALIASED).select("k", "t")
    return text.alias_references(text.aliases(d, "k", "t"), d, "k", "t")


@register("alias_assignment", f"with {_SQL} select k, 0::int as sentence_no, 'Series ' || chr((65 + k % 26)::int) || ' Warrants' as origin, 'Series ' || chr((65 + k % 26)::int) || ' Rights' as alias, round(3.0 / 4 + 2.0 / 3, 6) as score from o where k % 3 = 0")
def alias_assignment(spark, sf):
    # the name is on the right, on the left, or after a stop
    t = "concat(case k % 3 when 0 then concat('Offered are Series ', chr(65 + k % 26), ' Warrants (the \"Series ', chr(65 + k % 26), ' Rights\") today.') when 1 then concat('Those (the \"Series ', chr(65 + k % 26), ' Rights\") are Series ', chr(65 + k % 26), ' Warrants.') else concat('Offered are Series ', chr(65 + k % 26), ' Warrants (together, the \"Series ', chr(65 + k % 26), ' Rights\") today.') end)"
    return text.assign_aliases(_said(spark, sf, t=t).select("k", "t"), "k", "t", least=1.4).withColumn("score", F.round("score", 6))


@register("best_aliases", f"with {_SQL}, p as (select k % 97 as g, k, 1.0 + (k * 7919 % 100) / 100.0 as score from o where k % 97 > 0), t as (select * from p where score >= 1.4) select g, k, score::double as score from t qualify row_number() over (partition by g order by score desc, k) = 1")
def best_aliases(spark, sf):
    o = _said(spark, sf).where("k % 97 > 0").selectExpr("k % 97 as g", "k", "cast(1.0 + (k * 7919 % 100) / 100.0 as double) as score")
    return text.best_alias(o, "k", "g", "score")


@register("alias_scores", f"with {_SQL} select k, round(0.7 / (1 + k % 5) + 3.0 / (1 + k % 7) + case when k % 11 = 0 then 1.0 else (k % 3) / 3.0 end, 9)::double as score from o")
def alias_scores(spark, sf):
    v = lambda m: F.expr(f"cast(1 + k % {m} as double)")
    return _said(spark, sf).select("k", F.round(text.alias_score(v(5), v(7), F.expr("cast(k % 3 as double)"), F.lit(3.0), F.expr("k % 11 = 0")), 9).alias("score"))


@register("second_pass", f"with {_SQL} select k, 'series a warrant' as secu_key, (1 + k % 3) as n from o union all select k, 'common stock', 1 + k % 2 from o")
def second_pass(spark, sf):
    t = "concat('We sell Series A Warrants and common stock', repeat(', a SERIES A warrant', int(k % 3)), if(k % 2 = 1, ' and Common Stock.', '.'))"
    return text.second_pass(_said(spark, sf, t=t).select("k", "t"), "k", "t").groupBy("k", "secu_key").agg(F.count("*").alias("n"))


_STATED = ("An at the market program, by a sales agreement with Agent.", "SUBJECT TO COMPLETION. The selling stockholders offer shares.", "We may sell from time to time in one or more offerings.", "A shelf registration; the details are not complete and may be changed.", "We will not receive any proceeds.", "Plain words from a market in completion.")


@register("doc_classify", f"with {_SQL} select k, case k % 6 when 0 then 'atm' when 1 then 'preliminary,resale' when 2 then 'shelf' when 3 then 'preliminary,shelf' when 4 then 'resale' else '' end as labels from o")
def doc_classify(spark, sf):
    return _said(spark, sf, t=_case("k", *_STATED)).select("k", F.array_join(text.classify(F.col("t")), ",").alias("labels"))


@register("doc_classify_whole", r"""
    select doc_id, array_to_string(list_sort(list_filter([
        case when regexp_matches(text, '(?i)at[\s-]the[\s-]market|equity\s+distribution\s+agreement|sales\s+agreement\s+with') then 'atm' end,
        case when regexp_matches(text, 'SUBJECT TO COMPLETION|(?:is|are) not complete and may be changed') then 'preliminary' end,
        case when regexp_matches(text, '(?i)selling\s+(?:security|stock|share)\s*holders?|we\s+will\s+not\s+receive\s+any\s+(?:of\s+the\s+)?proceeds') then 'resale' end,
        case when regexp_matches(text, '(?i)from\s+time\s+to\s+time.{0,200}(?:one\s+or\s+more|offerings?)|shelf\s+registration') then 'shelf' end], lambda x: x is not null)), ',') as labels from t""".replace("select doc_id, array", "with t as (select doc_id, text || case doc_id % 4 when 0 then ' shelf registration' when 1 then ' equity distribution agreement' else '' end as text from documents) select doc_id, array"))
def doc_classify_whole(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.expr("case doc_id % 4 when 0 then ' shelf registration' when 1 then ' equity distribution agreement' else '' end")).alias("t"))
    return d.select("doc_id", F.array_join(text.classify(F.col("t")), ",").alias("labels"))


_NAMED = ("Common stock", "Series B preferred shares", "Stock option", "Warrant on common stock", "Purchase warrants", "Senior notes", "Units")


@register("type_by_keyword", f"with {_SQL} select k, case k % 7 when 0 then 'CommonShare' when 1 then 'PreferredShare' when 2 then 'Option' when 3 then 'CommonShare' when 4 then 'Warrant' else 'DebtSecurity' end as kind, case k % 7 when 0 then 'common stock' when 1 then 'series b preferred' when 2 then 'stock option' when 3 then 'warrant on common stock' when 4 then 'purchase warrant' when 5 then 'senior note' else 'unit' end as key from o")
def type_by_keyword(spark, sf):
    return _said(spark, sf, t=_case("k", *_NAMED)).select("k", S.security_type(F.col("t")).alias("kind"), S.security_key(F.col("t")).alias("key"))


@register("securities_typed", f"""with {_SQL} select k, 'series a warrant' as security_name, 'Warrant' as security_type, p as price, strftime(day, '%Y-%m-%d') as expires from o where k % 2 = 0
    union all select k, 'common stock', 'CommonShare', null, null from o""")
def securities_typed(spark, sf):
    t = "concat('Our common stock is listed. The stock option lapses. ', if(k % 2 = 0, concat('The exercise price of the Series A Warrants is ${PRICE}. '), ''), 'The Series A warrants expire on {DAY}.')"
    rows = extract.security_commands(_said(spark, sf, t=t).select("k", "t"), "k", "t")["securities"]
    got = lambda n: F.get_json_object("security_attributes", f"$.{n}")
    return rows.select("k", "security_name", "security_type", got("exercise_price").cast("double").alias("price"), got("expiry_date").alias("expires"))


@register("outstanding_commands", f"with {_SQL} select k as accn, 'common stock' as security_name, n::double as amount, strftime(day, '%Y-%m-%d') as instant from o")
def outstanding_commands(spark, sf):
    t = "concat('On {DAY} we had {NUM} shares of common stock outstanding. On {DAY} we had {NUM} shares of common stock outstanding.')"
    out = extract.security_commands(_said(spark, sf, t=t).select("k", "t"), "k", "t")
    both = out["securities_outstanding"].join(out["securities_accn_occurence"].select(F.col("accn").alias("k"), "security_name"), ["k", "security_name"])
    return both.select(F.col("k").alias("accn"), "security_name", "amount", _date(F.col("instant")).alias("instant"))


@register("enumeration_split", f"with {_SQL} select k, n::int as n, case n when 0 then '(a) item ' || k else '(b) item two' end as item from o, (values (0), (1)) v(n) where n = 0 or k % 2 = 1".replace("case n", "case v.n").replace("select k, n::int", "select k, v.n::int").replace("where n = 0", "where v.n = 0"))
def enumeration_split(spark, sf):
    t = "concat('as follows: (a) item ', k, if(k % 2 = 1, '; and (b) item two.', '.'))"
    return _said(spark, sf, t=t).select("k", F.posexplode(text.split_enumeration(F.col("t"))).alias("n", "item"))


@register("entity_export", f"with {_SQL} select k, 'Sold ' || n || ' shares.' as text, 5::int as start, (5 + length(n::varchar))::int as \"end\", n::varchar as found from o")
def entity_export(spark, sf):
    found = F.transform(text.places(F.col("t"), "[0-9]+"), lambda p: F.struct(p["start"], p["end"], F.lit("NUMBER").alias("label")))
    j = F.from_json(text.annotation(F.col("t"), found), "text string, ents array<struct<start int, end int, label string>>")
    e = F.get(j["ents"], F.lit(0))
    return _said(spark, sf, t="concat('Sold ', n, ' shares.')").select("k", j["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.substr(F.col("t"), e["start"] + 1, e["end"] - e["start"]).alias("found"))


@register("alias_find", r"""
    with p as (select doc_id, unnest(regexp_extract_all(text || ' Firm (the "Name' || doc_id || '") ends', '\([^(]*\)')) as paren from documents)
    select doc_id, paren, nullif(regexp_extract(paren, '"([^"“”]+)["”]', 1), '') as alias from p where regexp_matches(paren, '["“][^"“”]+["”]') and len(regexp_extract_all(paren, '["“]([^"“”]+)["”]')) = 1""")
def alias_find(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(' Firm (the "Name'), F.col("doc_id").cast("string"), F.lit('") ends')).alias("t"))
    found = text.aliases(d, "doc_id", "t")
    alone = found.groupBy("doc_id", "paren_no").agg(F.first("paren").alias("paren"), F.max("alias").alias("alias"), F.count("*").alias("n"))
    return alone.where("n = 1").select("doc_id", "paren", "alias")


@register("distinct_mentions", f"with {_SQL} select distinct case k % 3 when 0 then 'series ' || chr((97 + k % 26)::int) || ' warrant' when 1 then 'preferred stock' else 'debt security' end as mention from o")
def distinct_mentions(spark, sf):
    t = _case("k", "Buy Series ', chr(65 + k % 26), ' warrants.", "Preferred Stock is sold.", "Our debt securities are due.")
    return _said(spark, sf, t=t).select(F.explode(text.securities(F.col("t"))).alias("m")).select(S.security_key(F.col("m")).alias("mention")).distinct()


@register("coverage_counts", f"with {_SQL} select k % 50 as c, 'common stock' as secu_key, sum(1 + k % 2)::bigint as n, count(distinct p)::bigint as prices from o where k % 3 > 0 group by 1 union all select k % 50, 'series a warrant', count(*), count(distinct p) from o where k % 3 = 0 group by 1")
def coverage_counts(spark, sf):
    t = "if(k % 3 = 0, concat('The exercise price of Series A warrants is ${PRICE}.'), concat('Common stock at an exercise price of ${PRICE}.', if(k % 2 = 1, ' Common stock again.', '')))"
    s = text.explode_sentences(_said(spark, sf, t=t).selectExpr("struct(k % 50 as c, k) as k", "t"), "k", "t")
    m = s.select("k.c", F.explode(text.securities(F.col("sentence"))).alias("m"), text.exercise_price(F.col("sentence"))["amount"].alias("price"))
    return m.groupBy("c", S.security_key(F.col("m")).alias("secu_key")).agg(F.count("*").alias("n"), F.count_distinct("price").alias("prices"))


@register("greedy_spans")
def greedy_spans(spark, sf):
    """Words and word pairs of every whole document that start with a capital compete by length."""
    both = lambda c: F.concat(text.places(c, "\\b\\p{Lu}\\w+"), text.places(c, "\\b\\p{Lu}\\w+ \\w+"))
    d = table(spark, sf, "documents").select("doc_id", both(F.coalesce("text", F.lit(""))).alias("s"))
    spans = F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    kept = d.select("doc_id", intervals.keep_longest(spans).alias("kept"))
    return kept.select("doc_id", F.size("kept").alias("spans"), F.aggregate("kept", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("covered"))


@register("longest_match_per_start", "select l_orderkey, l_linenumber, max(l_quantity)::bigint as length from lineitem group by 1, 2")
def longest_match_per_start(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity as bigint) as length", "l_partkey")
    return text.longest_match_per_start(li.unionByName(li.withColumn("length", F.col("length") - 1)), ["l_orderkey"], "l_linenumber", "length").select("l_orderkey", "l_linenumber", "length")


@register("lemma_subsets", "select conv_id, turn, len(list_intersect(list_transform(string_split(lower(text), ' '), lambda w: w), ['the', 'of'])) = 2 as holds from conversations")
def lemma_subsets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.subset_of(F.split(F.lower("text"), " "), ["the", "of"]).alias("holds"))


@register("formatted_matches", f"with {_SQL} select k, case k % 3 when 0 then 'N' || n when 1 then lower('Day') end as value from o")
def formatted_matches(spark, sf):
    formats = {"number": lambda v: F.concat(F.lit("N"), v), "word": F.lower}
    o = _said(spark, sf).select("k", F.expr("case k % 3 when 0 then 'number' when 1 then 'word' else 'other' end").alias("id"), F.expr("if(k % 3 = 0, cast(n as string), 'Day')").alias("v"))
    return o.select("k", text.format_matches(F.col("id"), F.col("v"), formats).alias("value"))


_MET_AGAIN = "t as (select doc_id, regexp_extract_all(coalesce(text, ''), '[a-z]{7,}') as t from documents), w as (select doc_id, upper(t[1][1:1]) || t[1][2:] as a, upper(t[2][1:1]) || t[2][2:] as b from t where len(t) > 1 and t[1] <> t[2])"


def _met_again(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{7,}"), F.lit(0)).alias("t")).where("size(t) > 1 and t[0] <> t[1]")
    name = lambda i: F.initcap(F.get("t", F.lit(i)))
    a, b = name(0), name(1)
    said = F.concat(F.lit("In May "), a, F.lit(" Holdings Corp. filed a report. The company sold units to Mr. "), b, F.lit(". It waits. He kept his seat. "), a, F.lit(" ended. We met "), b, F.lit("."))
    return d.select("doc_id", a.alias("a"), said.alias("s"))


@register("coreference_chains", f"""with {_MET_AGAIN}
    select doc_id, 1::int as chain, a || ' Holdings Corp./The company/It/' || a as texts from w union all select doc_id, 2, 'Mr. ' || b || '/He/his/' || b from w""")
def coreference_chains(spark, sf):
    """Names made of each document's words: a company and a person taken up by a noun, by pronouns and by a part of the name."""
    d = _met_again(spark, sf)
    found = coreference.coreference(d, "doc_id", "s")
    # a planted text has a few mentions
    return found.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("m")).select("doc_id", "chain", F.array_join(F.col("m.text"), "/").alias("texts"))


@register("chain_references", f"""with {_MET_AGAIN}, s as (select doc_id, a, 'In May ' || a || ' Holdings Corp. filed a report. The company sold units to Mr. ' || b || '. It waits. He kept his seat. ' || a || ' ended. We met ' || b || '.' as s from w)
    select doc_id, a as alias, (strpos(s, 'The company') - 1)::int as start, (strpos(s, 'The company') + 10)::int as "end" from s union all select doc_id, a, (strpos(s, 'It waits') - 1)::int, (strpos(s, 'It waits') + 1)::int from s
    union all select doc_id, a, (strpos(s, a || ' ended') - 1)::int, (strpos(s, a || ' ended') - 1 + length(a))::int from s""")
def chain_references(spark, sf):
    """The later mentions of a company whose first mention has an alias, through the chains read from the sentences."""
    d = _met_again(spark, sf)
    mentions = coreference.coreference(d, "doc_id", "s").select("doc_id", "chain", "start", "end")
    known = d.select("doc_id", F.col("a").alias("alias"), F.lit(7).alias("start"), (F.lit(7) + F.length("a") + F.length(F.lit(" Holdings Corp."))).alias("end"))
    return text.chain_references(mentions, known, "doc_id")


_WORDS_OF = "t as (select doc_id as k, regexp_extract_all(coalesce(text, ''), '[a-z]{7,}') as t from documents), w as (select k, t[1] as a, t[2] as b, t[3] as c from t where len(t) > 2)"


@register("verb_groups", f"""with {_WORDS_OF}, m as (select *, ['may', 'will', 'could', 'must', 'are'][1 + k % 5] as m, ['', ' not', ' never', ' also'][1 + (k // 5) % 4] as x from w)
    select k, 0::int as n, a as verb, m || x as "group", (k // 5) % 4 in (1, 2) as negated, case when m not in ('will', 'are') then m end as marker, case m when 'may' then 0.2 when 'could' then 0.25 when 'must' then 0.9 else 1.0 end::double as level from m
    union all select k, 1, b, case when k % 2 = 0 then 'would not' else 'would' end, k % 2 = 0, 'would', 0.7 from m union all select k, 2, c, 'has been', false, null, 1.0 from m""")
def verb_groups(spark, sf):
    """Three verbs of a sentence, words of the document, each with a group of its own."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("k"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{7,}"), F.lit(0)).alias("t")).where("size(t) > 2")
    said = F.expr("concat('We ', array('may', 'will', 'could', 'must', 'are')[k % 5], array('', ' not', ' never', ' also')[(k div 5) % 4], ' ', t[0], ' on May 5, they ', if(k % 2 = 0, 'wouldn\\'t', 'would'), ' ', t[1], ' and it has  been ', t[2], '.')")
    return d.select("k", F.posexplode(text.verb_groups(said)).alias("n", "g")).select("k", "n", "g.*")
