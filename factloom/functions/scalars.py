"""Column functions: numbers, dates, intervals, labels and text clean-up. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words.
NUMBER_WORDS = {
    "no": 0, "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7, "eighth": 8, "ninth": 9, "tenth": 10, "eleventh": 11, "twelfth": 12,
}
#: Days of a time unit.
UNIT_DAYS = {"day": 1.0, "days": 1.0, "week": 7.0, "weeks": 7.0, "month": 30.0, "months": 30.0, "year": 365.25, "years": 365.25}
#: Keyword and security type, in order of precedence.
SECURITY_KEYWORDS = (("common", "CommonShare"), ("preferred", "PreferredShare"), ("option", "Option"), ("warrant", "Warrant"), ("note", "DebtSecurity"))
DATE_FORMATS = ("MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "M/d/yyyy")


def lookup(table: dict, key: Column) -> Column:
    """table[key], null where there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def once(value: Column, f) -> Column:
    """f(value) with the value computed once a row, however often f names it: an expression named twice is worked out twice, and nested ones by powers."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def american_number(text: Column) -> Column:
    """A number with comma groups and a decimal point, as double.

    One lone comma followed by one or two characters is a decimal comma. A point before a comma, and several points, give null.
    """
    points, commas = F.length(F.regexp_replace(text, "[^.]", "")), F.length(F.regexp_replace(text, "[^,]", ""))
    plain = F.regexp_replace(text, ",", "")
    decimal_comma = (points == 0) & (commas == 1) & text.rlike(",[0-9]{1,2}$")
    value = F.when(~text.rlike("^[0-9.,]*[0-9][0-9.,]*$"), None).when((points > 1) | text.rlike("[.].*,"), None).when(decimal_comma, F.regexp_replace(text, ",", ".")).otherwise(plain)
    return value.try_cast("double")


def quantity(text: Column) -> Column:
    """The number a phrase names: its digits as american_number, times million or billion (billion wins), else its number word."""
    digits = F.array_join(F.regexp_extract_all(text, F.lit("[0-9.,]+"), F.lit(0)), "")
    # the sentence's own stop or comma is no part of the number
    digits = F.regexp_replace(digits, "[.,]+$", "")
    scale = F.when(text.rlike("(?i)billions?"), 1e9).when(text.rlike("(?i)millions?"), 1e6).otherwise(1.0)
    return once(digits, lambda d: F.when(d != "", american_number(d) * scale).otherwise(number_word(F.trim(text))))


def number_word(word: Column) -> Column:
    return lookup(NUMBER_WORDS, F.lower(word)).cast("double")


def unit_days(word: Column) -> Column:
    return lookup(UNIT_DAYS, F.lower(word))


def durations(text: Column) -> Column:
    """array<double>: the days named by each "<number or number word> <unit>" of a phrase."""
    pairs = F.regexp_extract_all(text, F.lit("(?i)([0-9][0-9.,]*|" + "|".join(NUMBER_WORDS) + ")[ -]+(days?|weeks?|months?|years?)"), F.lit(0))

    def days(p: Column) -> Column:
        n, unit = F.regexp_extract(p, "^(\\S+?)[ -]+", 1), F.regexp_extract(p, "([A-Za-z]+)$", 1)
        return F.coalesce(american_number(n), number_word(n)) * unit_days(unit)

    return F.transform(pairs, days)


def as_interval(days: Column) -> Column:
    """A number of days as a day-time interval."""
    return F.make_dt_interval(F.floor(days).cast("int"), F.round((days - F.floor(days)) * 24).cast("int"))


def parse_date(text: Column) -> Column:
    """A date written with month names or digits; ordinal endings, commas and "of" are ignored. Null if no form fits."""
    plain = F.regexp_replace(text, "(?i)(?<=[0-9])(st|nd|rd|th)\\b", "")
    plain = F.trim(F.regexp_replace(F.regexp_replace(plain, "(?i)\\bof\\b|,", " "), "\\s+", " "))
    titled = F.initcap(F.lower(plain))
    return F.coalesce(*[F.try_to_date(titled, f) for f in DATE_FORMATS])


def normalise_text(text: Column) -> Column:
    """No-break and zero-width spaces to plain ones, runs of blanks to one, runs of line ends to one, ends trimmed."""
    steps = ((" 4", ""), ("[   ]", " "), ("[​‌‍﻿]", ""), ("[ \\t]+", " "), (" *\\r?\\n[ \\r\\n]*", "\n"))
    return F.trim(reduce(lambda c, step: F.regexp_replace(c, *step), steps, text))


def swap_case_after(text: Column, symbol: str) -> Column:
    """The letter after each symbol changes case."""
    parts = F.split(text, "\\Q" + symbol + "\\E")
    first = lambda p: F.substring(p, 1, 1)
    swapped = lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when(first(p) == F.upper(first(p)), F.lower(first(p))).otherwise(F.upper(first(p))), F.substring(p, 2, 1 << 30)))
    return F.array_join(F.transform(parts, swapped), symbol)


def roman(number: Column) -> Column:
    """A number from 1 to 3999 in Roman digits, lower case."""
    unit = lambda u: F.floor(F.pmod(number, F.lit(10 * u)) / u)
    names = {1000: "m", 100: "c", 10: "x", 1: "i"}
    fives, tens = {100: "d", 10: "l", 1: "v"}, {100: "m", 10: "c", 1: "x"}
    parts = [F.repeat(F.lit("m"), F.floor(number / 1000).cast("int"))]
    for u in (100, 10, 1):
        d, i, v, x = unit(u), names[u], fives[u], tens[u]
        parts.append(F.when(d == 9, i + x).when(d == 4, i + v).when(d >= 5, F.concat(F.lit(v), F.repeat(F.lit(i), (d - 5).cast("int")))).otherwise(F.repeat(F.lit(i), d.cast("int"))))
    return F.concat(*parts)


def span_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Distance of the middles of two spans."""
    return F.abs((a_start + a_end) / 2 - (b_start + b_end) / 2)


def security_type(name: Column) -> Column:
    """The first keyword in order of precedence decides; without one a debt security."""
    out = F
    for word, kind in SECURITY_KEYWORDS:
        out = out.when(F.lower(name).contains(word), kind)
    return out.otherwise("DebtSecurity")


def security_key(mention: Column) -> Column:
    """Lower case, without a trailing "shares", last word in the singular."""
    key = F.regexp_replace(F.lower(F.trim(mention)), "\\s+shares?$", "")
    return F.regexp_replace(F.regexp_replace(key, "(warrant|option|note|right|unit|contract)s$", "$1"), "securities$", "security")


def identifying_attributes(kind: Column, attributes: Column) -> Column:
    """The attributes that identify a security of a kind, or null if too few are known.

    A warrant needs one of expiry_date and exercise_price; an option two of strike_price, expiry and right; a debt security
    interest_rate and one of maturity and issue_date. Other kinds are identified by name.
    """
    of = lambda *names: F.map_filter(attributes, lambda k, v: k.isin("name", *names) & v.isNotNull())
    has = lambda *names: sum((attributes[n].isNotNull().cast("int") for n in names), F.lit(0))
    return (
        F.when(kind == "Warrant", F.when(has("expiry_date", "exercise_price") >= 1, of("expiry_date", "exercise_price")))
        .when(kind == "Option", F.when(has("strike_price", "expiry", "right") >= 2, of("strike_price", "expiry", "right")))
        .when(kind == "DebtSecurity", F.when(attributes["interest_rate"].isNotNull() & (has("maturity", "issue_date") >= 1), of("interest_rate", "maturity", "issue_date")))
        .otherwise(of())
    )


def accession(number: Column) -> Column:
    """An accession number without dashes."""
    return F.when(F.length(number) == 18, number).otherwise(F.replace(number, F.lit("-"), F.lit("")))


def submission_url(base: Column, cik: Column, number: Column, document: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), cik, accession(number), document)


def extension(path: Column) -> Column:
    """The last suffix of a path, dot included; null if it has none."""
    return F.nullif(F.regexp_extract(path, "[^/\\\\]+(\\.[^./\\\\]+)$", 1), F.lit(""))


def is_outdated(updated: Column, max_age_hours: float, now: Column) -> Column:
    """More than max_age_hours before now; never updated counts as outdated."""
    return F.coalesce(F.timestamp_diff("SECOND", updated, now) > max_age_hours * 3600, F.lit(True))


def char_to_token(starts: Column, lengths: Column, at: Column) -> Column:
    """Index of the token that covers a character, null between tokens. Starts ascend: the last one not after the character tells."""
    last = F.size(F.filter(starts, lambda s: s <= at)) - 1
    return F.when((last >= 0) & (at < F.get(starts, last) + F.get(lengths, last)), last)


def nested(array: Column, f) -> Column:
    """f on every element of an array of arrays."""
    return F.transform(array, lambda row: F.transform(row, f))
