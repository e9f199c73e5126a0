"""Filters and lookups on rows, records and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import accession, submission_url

#: Fixed value: texts above this length are not parsed.
MAX_CHARS = 999_999


def of_forms(filings: DataFrame, form: str, forms: list[str] | str) -> DataFrame:
    """Filings of the tracked forms, or all of them."""
    return filings if forms == "all" else filings.where(F.col(form).isin(list(forms)))


def with_default(column: Column, default: object) -> Column:
    return F.coalesce(column, F.lit(default))


def present(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is wanted."""
    return rows.join(wanted, keys, "left_semi")


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known, keys, "left_anti")


def has_required(record: Column, names: list[str]) -> Column:
    """A map that holds every name with a value."""
    return F.forall(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(record, n) & F.element_at(record, n).isNotNull())


def not_too_long(rows: DataFrame, text: str, limit: int = MAX_CHARS) -> DataFrame:
    return rows.where(F.length(text) <= limit)


def submissions(raw: DataFrame, key: str, recent: str, base_url: str) -> DataFrame:
    """Rows of a struct of parallel arrays: key, accn, form_type, filing_date, file_number, description, url."""
    fields = ("accessionNumber", "filingDate", "form", "fileNumber", "primaryDocument", "primaryDocDescription")
    rows = raw.select(key, F.inline(F.arrays_zip(*[F.col(f"{recent}.{f}").alias(f) for f in fields])))
    return rows.select(
        key, accession(F.col("accessionNumber")).alias("accn"), F.col("form").alias("form_type"), F.to_date("filingDate").alias("filing_date"), F.col("fileNumber").alias("file_number"),
        F.col("primaryDocDescription").alias("description"), submission_url(F.lit(base_url), F.col(key), F.col("accessionNumber"), F.col("primaryDocument")).alias("url"),
    )


def hash_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by a seeded hash of the key: the same on every engine and run."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).limit(k)


def cap_per_group(rows: DataFrame, group: str, order: list[Column], most: int) -> DataFrame:
    from pyspark.sql import Window as W

    return rows.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def route(form: Column, suffix: Column, registry: dict[tuple[str | None, str], str]) -> Column:
    """The handler registered for (form, suffix), else for (None, suffix), else null."""
    exact = F.create_map(*[F.lit(x) for (f, s), h in registry.items() if f is not None for x in (f"{f}|{s}", h)])
    general = F.create_map(*[F.lit(x) for (f, s), h in registry.items() if f is None for x in (s, h)])
    return F.coalesce(F.element_at(exact, F.concat_ws("|", form, suffix)), F.element_at(general, suffix))


def numbered(rows: DataFrame, by: str, then: list[str], name: str) -> DataFrame:
    """rows with their place, from 1, in the order of `by` and then `then`; `by` is dropped.

    Each value of `by` is numbered in a task of its own; its offset comes from the counts of all values, one row a value.
    """
    from pyspark.sql import Window as W

    counts = rows.groupBy(by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy(by).orderBy(*then))
    placed = rows.withColumn("_in", inside).join(counts.select(by, before.alias("_before")), by)
    return placed.withColumn(name, (F.col("_before") + F.col("_in")).cast("int")).drop("_in", "_before", by)
