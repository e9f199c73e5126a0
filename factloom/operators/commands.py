"""Commands on a company's tables, each with its own rule for what is known, absent or unmatched.

Every function takes the table it changes and the new rows, which carry `seq`, their place in the queue; it gives the
new table, and where rows can fail to apply, a table of those with a reason. A failing row never stops the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .facts import dedup_by
from .state import insert_ignore, resolve_dimension


def add(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Companies, codes, form types, securities, registrations, effectiveness notices: added unless the key is present; the first in the queue wins."""
    return insert_ignore(table, new, keys, [F.col("seq")])


def _split(rows: DataFrame, found: str, reason: str, like: DataFrame) -> tuple[DataFrame, DataFrame]:
    hit = rows.where(F.col(found).isNotNull())
    return hit, rows.where(F.col(found).isNull()).select("seq", F.lit(reason).alias("reason"))


def add_offerings(offerings: DataFrame, new: DataFrame, shelves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offerings (company_id, accn, ...) attached as shelf_accn to the company's shelf with the offering's own accn; without one they are left out and listed.

    shelves: (company_id, accn), with seq where a command of the same queue adds the shelf; one that comes later does not count.
    """
    since = F.coalesce("seq", F.lit(-1)) if "seq" in shelves.columns else F.lit(-1)
    known = shelves.groupBy("company_id", "accn").agg(F.min(since).alias("_since")).select("company_id", "accn", "_since", F.col("accn").alias("_shelf"))
    met = new.join(known, ["company_id", "accn"], "left").withColumn("_shelf", F.when(F.col("_since") < F.col("seq"), F.col("_shelf")))
    hit, missed = _split(met, "_shelf", "no shelf registration of this accn", offerings)
    return add(offerings, hit.withColumn("shelf_accn", F.col("_shelf")), ["company_id", "accn"]), missed


def add_registrations(registrations: DataFrame, new: DataFrame, offerings: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Registered securities (company_id, offering_accn, ...) of an offering the company has; without one it is an error, listed.

    offerings: (company_id, accn), with seq where a command of the same queue adds the offering; one that comes later does not count.
    """
    since = F.coalesce("seq", F.lit(-1)) if "seq" in offerings.columns else F.lit(-1)
    known = offerings.groupBy("company_id", F.col("accn").alias("offering_accn")).agg(F.min(since).alias("_since"))
    met = new.join(known, ["company_id", "offering_accn"], "left").withColumn("_known", F.when(F.col("_since") < F.col("seq"), 1))
    hit, missed = _split(met, "_known", "error: no shelf offering of this accn", registrations)
    return add(registrations, hit, keys), missed


def by_attributes(new: DataFrame, securities: DataFrame) -> DataFrame:
    """new (company_id, attributes: map<string, string>) with the id of the company's first security whose JSON holds every attribute, else null.

    securities: (company_id, id, security_attributes JSON). No attributes, a null value and an attribute without an entry match nothing.

    A relational division over an inverted index: securities are posted under each (company, key, value); each different set
    of attributes asked for looks up the postings of its rarest pair, and those candidates whose other pairs are all posted too are counted out. So a value
    that all securities share is looked up only where it is all that was asked, and commands that ask the same share one answer.
    """
    asked = F.array_sort(F.map_entries("attributes"))
    wanted = new.where("size(attributes) > 0 and company_id is not null").select("company_id", asked.alias("_asked")).distinct()
    pairs = wanted.select("company_id", "_asked", F.size("_asked").alias("_n"), F.explode("_asked").alias("_pair")).select("company_id", "_asked", "_n", F.col("_pair.key").alias("_key"), F.col("_pair.value").alias("_value"))
    held = securities.select("company_id", F.col("id").alias("_id"), F.explode(F.from_json("security_attributes", "map<string, string>")).alias("_key", "_value")).distinct()
    on = ["company_id", "_key", "_value"]
    length = held.groupBy(*on).agg(F.count("*").alias("_length"))
    # a pair that nothing holds leaves its set unanswered
    rarest = pairs.join(length, on).groupBy("company_id", "_asked", "_n").agg(F.count("*").alias("_found"), F.min(F.struct("_length", "_key", "_value")).alias("_best")).where("_found = _n")
    candidates = rarest.select("company_id", "_asked", "_n", F.col("_best._key").alias("_key"), F.col("_best._value").alias("_value")).join(held, on).select("company_id", "_asked", "_n", "_id")
    single = candidates.where("_n = 1").select("company_id", "_asked", "_id")
    rest = candidates.where("_n > 1").withColumn("_pair", F.explode("_asked")).select("company_id", "_asked", "_n", "_id", F.col("_pair.key").alias("_key"), F.col("_pair.value").alias("_value"))
    several = rest.join(held, [*on, "_id"], "left_semi").groupBy("company_id", "_asked", "_n", "_id").agg(F.count("*").alias("_met")).where("_met = _n").select("company_id", "_asked", "_id")
    answer = single.unionByName(several).groupBy("company_id", "_asked").agg(F.min("_id").alias("security_id"))
    return new.withColumn("_asked", asked).join(answer, ["company_id", "_asked"], "left").drop("_asked")


def add_outstanding(facts: DataFrame, new: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outstanding amounts (security_id, amount, instant) of securities found by attributes; a fact is held once. Unmatched ones are listed."""
    hit, missed = _split(by_attributes(new, securities), "security_id", "no security with these attributes", facts)
    return add(facts, hit, ["security_id", "amount", "instant"]), missed


def add_occurrences(occurrences: DataFrame, new: DataFrame, securities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filings (security_id, accn) in which a security found by attributes occurs; unmatched and repeated ones are listed."""
    hit, missed = _split(by_attributes(new, securities), "security_id", "no security with these attributes", occurrences)
    first = dedup_by(hit, ["security_id", "accn"], [F.col("seq")])
    fresh = first.join(occurrences.select("security_id", "accn"), ["security_id", "accn"], "left_anti")
    again = hit.join(fresh.select("seq"), "seq", "left_anti").select("seq", F.lit("already present").alias("reason"))
    return occurrences.unionByName(fresh.select(*occurrences.columns)), missed.unionByName(again)


def add_filing_links(links: DataFrame, new: DataFrame, form_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, form types): links are added unless present; a form type not known yet is created with category unspecified."""
    forms = resolve_dimension(form_types, new, "form_type", "form_type", category="unspecified")
    return add(links, new, ["company_id", "url"]), forms
