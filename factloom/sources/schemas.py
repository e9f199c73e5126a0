"""Schemas of the stored tables and their keys. Keys are tested invariants: Spark doesn't enforce them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FLOW = "company_id int, from_date date, to_date date, amount bigint"
_REGISTERED = "security_id int, {parent} int, source_security_id int, amount_security bigint, amount_dollar bigint"
#: Fixed values: (columns, key) of each table.
TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "files_last_update": ("submissions_zip_lud timestamp_ntz, companyfacts_zip_lud timestamp_ntz", ()),
    "sics": ("sic int, sector string, industry string, division string", ("sic",)),
    "companies": ("id int, cik string, sic int, symbol string, name_ string, description_ string", ("cik",)),
    "company_last_update": ("company_id int, filings_download_lud timestamp_ntz, filing_links_lud timestamp_ntz, outstanding_shares_lud timestamp_ntz, net_cash_and_equivalents_lud timestamp_ntz, cash_burn_rate_lud timestamp_ntz", ("company_id",)),
    "filing_parse_history": ("company_id int, accession_number string, date_parsed date", ("company_id", "accession_number")),
    "outstanding_shares": ("company_id int, instant date, amount bigint", ("company_id", "instant")),
    "market_cap": ("company_id int, instant date, amount bigint", ("company_id", "instant")),
    "cash_operating": (_FLOW, ("company_id", "from_date", "to_date")),
    "cash_financing": (_FLOW, ("company_id", "from_date", "to_date")),
    "cash_investing": (_FLOW, ("company_id", "from_date", "to_date")),
    "net_cash_and_equivalents": ("company_id int, instant date, amount bigint", ("company_id", "instant")),
    "cash_burn_rate": ("company_id int, burn_rate_operating double, burn_rate_financing double, burn_rate_investing double, burn_rate_total double, from_date date, to_date date", ("company_id", "from_date")),
    "cash_burn_summary": ("company_id int, burn_rate double, burn_rate_date date, net_cash double, net_cash_date date, days_of_cash double, days_of_cash_date date", ("company_id",)),
    "form_types": ("form_type string, category string", ("form_type",)),
    "filing_links": ("company_id int, filing_html string, accn string, form_type string, filing_date date, description_ string, file_number string", ("filing_html",)),
    "underwriters": ("id int, name_ string", ("id",)),
    "effect_registrations": ("company_id int, accn string, form_type string, file_number string, effective_date date", ("accn",)),
    "shelf_registrations": ("company_id int, accn string, file_number string, form_type string, capacity string, total_amount_raised bigint, effect_date date, last_update date, expiry date, filing_date date, is_active boolean", ("accn",)),
    "resale_registrations": ("company_id int, accn string, file_number string, form_type string, effect_date date, last_update date, expiry date, filing_date date, is_active boolean", ("accn",)),
    "offering_status": ("id int, name_ string", ("name_",)),
    "shelf_offerings": ("shelf_registrations_id int, accn string, filing_date date, offering_type string, final_offering_amount bigint, anticipated_offering_amount bigint, offering_status_id int, commencment_date date, end_date date", ("accn",)),
    "underwriters_shelf_offerings": ("offerings_id int, underwriter_id int", ("offerings_id", "underwriter_id")),
    "securities": ("company_id int, security_name string, security_type string, underlying_security_id int, security_attributes string", ("company_id", "security_name", "security_type")),
    "securities_accn_occurence": ("security_id int, accn string", ("security_id", "accn")),
    "securities_cusip": ("cusip_number string, security_id int", ("cusip_number",)),
    "securities_conversion": ("from_security_id int, to_security_id int, conversion_attributes string", ("from_security_id", "to_security_id", "conversion_attributes")),
    "securities_shelf_offerings_registered": (_REGISTERED.format(parent="shelf_offerings_id"), ("security_id", "shelf_offerings_id", "source_security_id")),
    "securities_shelf_offerings_completed": (_REGISTERED.format(parent="shelf_offerings_id"), ("security_id", "shelf_offerings_id", "source_security_id")),
    "securities_resale_registered": (_REGISTERED.format(parent="resale_registrations_id"), ("security_id", "resale_registrations_id", "source_security_id")),
    "securities_resale_completed": (_REGISTERED.format(parent="resale_registrations_id"), ("security_id", "resale_registrations_id", "source_security_id")),
    "securities_outstanding": ("security_id int, amount bigint, instant date", ("security_id", "amount", "instant")),
    "securities_authorized": ("company_id int, security_type string, amount bigint, instant date", ("company_id", "security_type", "amount", "instant")),
    "items8k": ("id int, item_name string", ("item_name",)),
    "form8k": ("cik string, file_date date, item_id int, content string", ("cik", "file_date", "item_id")),
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name][0])


def violations(table: DataFrame, name: str) -> DataFrame:
    """Keys that occur more than once."""
    keys = TABLES[name][1]
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def create_all(spark: SparkSession, database: str) -> None:
    """Creates every table as Parquet in a database; existing ones stay."""
    spark.sql(f"create database if not exists {database}")
    for name, (columns, _) in TABLES.items():
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def drop_all(spark: SparkSession, database: str) -> None:
    spark.sql(f"drop database if exists {database} cascade")
