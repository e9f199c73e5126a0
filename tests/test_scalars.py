import datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S


def values(spark, f, cases):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_american_number(spark):
    cases = {"10": 10.0, "10.0": 10.0, "250,000.25": 250000.25, "100,000": 100000.0, "100.00,000": None, "100,000.000,000": None, "100.000,000.000": None, "7,5": 7.5, "": None, ",": None, None: None}
    assert values(spark, S.american_number, list(cases)) == list(cases.values())


def test_quantity(spark):
    cases = {"up to $75,000,000": 75e6, "up to $7.5 million": 7.5e6, "up to $7,5 million": 7.5e6, "up to $0.0075 billion": 7.5e6, "11.5": 11.5, "700,000": 7e5, "150,000.25": 150000.25, "no": 0.0, "a few": None, None: None}
    assert values(spark, S.quantity, list(cases)) == list(cases.values())


def test_durations_and_dates(spark):
    assert values(spark, S.durations, ["3 weeks", "three weeks", "due 2 weeks or else six weeks later", "soon"]) == [[21.0], [21.0], [14.0, 42.0], []]
    day = datetime.date(2020, 4, 14)
    assert values(spark, S.parse_date, ["April 14th 2020", "April 14, 2020", "14th April 2020", "14 of April 2020", "nothing"]) == [day] * 4 + [None]


def test_small_functions(spark):
    assert values(spark, lambda c: S.roman(F.length(c)), ["x" * n for n in (1, 4, 9, 14, 40, 99)]) == ["i", "iv", "ix", "xiv", "xl", "xcix"]
    assert values(spark, S.security_type, ["common stock warrant", "Series A Preferred", "Warrants", "Senior bonds"]) == ["CommonShare", "PreferredShare", "Warrant", "DebtSecurity"]
    assert values(spark, S.security_key, ["Warrants", "common stock shares", "Debt Securities"]) == ["warrant", "common stock", "debt security"]
    assert values(spark, S.accession, ["0001-22-000003", "000000000000000001"]) == ["000122000003", "000000000000000001"]
    assert values(spark, S.extension, ["a/b.c/d.htm", "a/b", "x.tar.gz"]) == [".htm", None, ".gz"]
    assert values(spark, lambda c: S.swap_case_after(c, "-"), ["pre-Funded", "a-b-C"]) == ["pre-funded", "a-B-c"]
    assert values(spark, S.normalise_text, ["a \t b\n\n c​"]) == ["a b\nc"]


def test_age(spark):
    lud = F.lit("2022-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda h: F.lit(f"2022-01-01 {h}:00:00").cast("timestamp_ntz")
    row = spark.range(1).select(S.is_outdated(lud, 22, at(23)).alias("a"), S.is_outdated(lud, 22, at(21)).alias("b"), S.is_outdated(F.lit(None).cast("timestamp_ntz"), 22, at(21)).alias("c")).first()
    assert (row.a, row.b, row.c) == (True, False, True)


@pytest.mark.parametrize("kind,attrs,n", [("Warrant", {"name": "w", "exercise_price": "1"}, 2), ("Warrant", {"name": "w"}, None), ("Option", {"name": "o", "strike_price": "1"}, None), ("DebtSecurity", {"name": "d", "interest_rate": "1", "maturity": "2"}, 3)])
def test_identifying(spark, kind, attrs, n):
    row = spark.createDataFrame([(kind, attrs)], "k string, a map<string, string>").select(F.map_keys(S.identifying_attributes(F.col("k"), F.col("a"))).alias("x")).first()
    assert (None if row.x is None else len(row.x)) == n
