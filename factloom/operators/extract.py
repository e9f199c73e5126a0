"""From sectioned filings to registrations, offerings and securities: rows of commands for the state operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import security_type
from . import html, items, predicates, text

#: Days of a shelf's life, and of an offering at the market.
SHELF_DAYS, OFFERING_DAYS = 1125, 1095
#: Stand-ins for attributes that filings seldom state.
WARRANT_RIGHT, WARRANT_MULTIPLIER, DEBT_INTEREST = "Call", 1.0, 0.05
HANDLERS = {("S-3", ".htm"): "s3", ("EFFECT", ".xml"): "effect", (None, ".htm"): "htm"}


def attributes(kind: Column, name: Column, price: Column, expiry: Column) -> Column:
    """JSON attributes of a security in a fixed key order; null if a mandatory one is missing."""
    text_of = lambda c: c.cast("string")
    return (
        F.when(kind == "CommonShare", F.to_json(F.struct(name.alias("name"), F.lit(0.001).alias("par_value"))))
        .when(kind == "PreferredShare", F.to_json(F.struct(name.alias("name"), F.lit(0.001).alias("par_value"))))
        .when((kind == "Warrant") & price.isNotNull(), F.to_json(F.struct(name.alias("name"), price.alias("exercise_price"), F.lit(WARRANT_RIGHT).alias("right"), F.lit(WARRANT_MULTIPLIER).alias("multiplier"), text_of(expiry).alias("expiry_date"))))
        .when((kind == "Option") & price.isNotNull() & expiry.isNotNull(), F.to_json(F.struct(name.alias("name"), price.alias("strike_price"), text_of(expiry).alias("expiry"), F.lit(WARRANT_RIGHT).alias("right"), F.lit(100.0).alias("multiplier"))))
        .when((kind == "DebtSecurity") & expiry.isNotNull(), F.to_json(F.struct(name.alias("name"), F.lit(DEBT_INTEREST).alias("interest_rate"), text_of(expiry).alias("maturity"))))
    )


def extract_securities(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, security_name, security_type, security_attributes: each security of a document once; those without mandatory attributes are left out."""
    found = text.security_objects(docs, key, body)
    kind = security_type(F.col("secu_key"))
    rows = found.select(key, F.col("secu_key").alias("security_name"), kind.alias("security_type"), attributes(kind, F.col("secu_key"), F.col("exercise_price"), F.col("expiry_date")).alias("security_attributes"))
    return rows.where("security_attributes is not null")


def security_commands(docs: DataFrame, key: str, body: str) -> dict[str, DataFrame]:
    """The three tables a filing yields: securities, their occurrences (by accn = key), outstanding amounts."""
    secu = extract_securities(docs, key, body)
    relations = text.security_relations(docs, key, body).where(text.is_outstanding_quantity(F.struct("negated", "date", "certainty", "amods", "amount")))
    return {
        "securities": secu,
        "securities_accn_occurence": secu.select(F.col(key).alias("accn"), "security_name").distinct(),
        "securities_outstanding": relations.select(key, F.col("secu_key").alias("security_name"), "amount", F.col("date").alias("instant")).distinct(),
    }


def shelf_commands(filings: DataFrame, sections: DataFrame) -> dict[str, DataFrame]:
    """Registrations of S-3 filings (accn, file_number, filing_date, form_type) by the labels of their cover page (sections of key accn).

    shelf: with its capacity and expiry; resale; atm: an offering of OFFERING_DAYS from the filing date, joined to the shelf with its file number.
    """
    # the cover page, else what comes first
    place = F.row_number().over(W.partitionBy("accn").orderBy(F.col("title") != "cover page", "number"))
    cover = sections.withColumn("_r", place).where("_r = 1").select("accn", F.col("text").alias("cover"), "tables")
    front = filings.join(cover, "accn", "left").withColumn("labels", text.classify(F.coalesce("cover", F.lit(""))))
    rows = F.get(html.tables_of(F.col("tables"), "registration_table", "extracted"), F.lit(0))["rows"]
    has = lambda x: F.array_contains("labels", x)
    expiry = F.date_add("filing_date", SHELF_DAYS)
    shelf = front.where(has("shelf") & ~has("atm")).select("accn", "form_type", "file_number", F.coalesce(html.shelf_capacity(rows), text.aggregate_offering(F.col("cover")).cast("string")).alias("capacity"), "filing_date", expiry.alias("expiry"), has("preliminary").alias("is_preliminary"))
    resale = front.where(has("resale")).select("accn", "form_type", "file_number", "filing_date", expiry.alias("expiry"), has("preliminary").alias("is_preliminary"))
    first = shelf.withColumn("_r", F.row_number().over(W.partitionBy("file_number").orderBy("filing_date", "accn"))).where("_r = 1").select("file_number", F.col("accn").alias("shelf_accn"))
    atm = front.where(has("atm")).join(first, "file_number", "left").select("accn", "shelf_accn", F.lit("ATM").alias("offering_type"), text.aggregate_offering(F.col("cover")).alias("anticipated_offering_amount"), F.col("filing_date").alias("commencment_date"), F.date_add("filing_date", OFFERING_DAYS).alias("end_date"))
    return {"shelf_registrations": shelf, "resale_registrations": resale, "shelf_offerings": atm}


def parse_new(filings: DataFrame, history: DataFrame, forms: list[str] | str, as_of: str) -> dict[str, DataFrame]:
    """One incremental round over filings (accn, form_type, file_number, filing_date, path, content): what they yield, and the new history.

    Filings already in history (accession_number, date_parsed) are left out, the rest filtered by form and routed by form and suffix; those
    without a handler are listed in `unhandled`. Parsing is one narrow Arrow stage.
    """
    fresh = filings.join(history.select(F.col("accession_number").alias("accn")), "accn", "left_anti")
    routed = predicates.of_forms(fresh, "form_type", forms).withColumn("handler", predicates.route(F.col("form_type"), F.regexp_extract("path", "(\\.[^.]+)$", 1), HANDLERS))
    pages = routed.where("handler in ('s3', 'htm')")
    sections = html.split_sections(pages, "accn", "content")
    out = shelf_commands(routed.where("handler = 's3'"), sections)
    out |= security_commands(sections.select("accn", F.col("text").alias("body")), "accn", "body")
    out["effect_registrations"] = items.effectiveness(routed.where("handler = 'effect'"), "accn", "content")
    out["unhandled"] = routed.where("handler is null").select("accn", "form_type")
    done = routed.where("handler is not null").select(F.col("accn").alias("accession_number"), F.lit(as_of).cast("date").alias("date_parsed"))
    out["filing_parse_history"] = history.select("accession_number", "date_parsed").unionByName(done)
    return out
