"""Readers and writers of the reference formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import extension

#: Rows of a filing index.
INDEX_SCHEMA = "form_type string, file_number string, file_path string, filing_date date"
SIC_SCHEMA = "sic int, sector string, industry string, division string"
OVERVIEW_SCHEMA = "ticker string, name string, cik string, sic_code string, sic_description string, market_cap double, description string, list_date string, share_class_shares_outstanding long, weighted_shares_outstanding long"
SUBMISSIONS_SCHEMA = "cik string, filings struct<recent: struct<accessionNumber: array<string>, filingDate: array<string>, form: array<string>, fileNumber: array<string>, primaryDocument: array<string>, primaryDocDescription: array<string>>>"


def cik_of(path: str = "_metadata.file_path"):
    return F.regexp_extract(F.col(path), "CIK([0-9]{10})", 1)


def read_companyfacts(spark: SparkSession, path: str) -> DataFrame:
    """cik, json: one row per CIK<10 digits>.json file."""
    return spark.read.text(path, wholetext=True).select(cik_of().alias("cik"), F.col("value").alias("json"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUBMISSIONS_SCHEMA).json(path, multiLine=True).withColumn("cik", F.coalesce(F.lpad("cik", 10, "0"), cik_of()))


def defaulted(overviews: DataFrame) -> DataFrame:
    """Company overviews that have a cik; a missing code is 9999, Nonclassifiable."""
    rows = overviews.where("cik is not null")
    return rows.withColumns({"sic_description": F.when(F.col("sic_code").isNull(), "Nonclassifiable").otherwise(F.col("sic_description")), "sic_code": F.coalesce("sic_code", F.lit("9999"))})


def read_overviews(spark: SparkSession, path: str) -> DataFrame:
    return defaulted(spark.read.schema(OVERVIEW_SCHEMA).json(path, multiLine=True))


def read_sics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=SIC_SCHEMA)


def read_index(spark: SparkSession, path: str, cik: str = "([0-9]+)\\.csv$") -> DataFrame:
    """A folder of <cik>.csv indexes, or another pattern of the cik in their paths; paths come out with forward slashes."""
    rows = spark.read.csv(path, header=True, schema=INDEX_SCHEMA).withColumn("cik", F.regexp_extract(F.col("_metadata.file_path"), cik, 1))
    return rows.withColumn("file_path", F.translate("file_path", "\\", "/"))


def index_by_file_number(index: DataFrame) -> DataFrame:
    return index.groupBy("cik", "file_number").agg(F.sort_array(F.collect_list(F.struct("filing_date", "form_type", "file_path"))).alias("files"))


def read_documents(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, extension, content of every file under root whose name fits."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return rows.withColumn("extension", extension(F.col("path")))


def files_older_than(spark: SparkSession, path: str, hours: float, now: str) -> DataFrame:
    """Paths whose last change lies more than `hours` before now."""
    rows = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return rows.where(F.timestamp_diff("SECOND", F.col("modificationTime"), F.lit(now).cast("timestamp")) > hours * 3600).select("path")


def write_sections(sections: DataFrame, title: str, delimiter: str, path: str) -> None:
    """Texts of the sections whose title matches, as delimited text files."""
    sections.where(F.col("title").rlike(title)).select("text").write.option("lineSep", delimiter).text(path)


def section_failures(docs: DataFrame, sections: DataFrame, key: str, title: str) -> DataFrame:
    """key, reason: documents of an export that give nothing to it: `no text`, where the split found no section, or `no section of this title`."""
    found = sections.groupBy(key).agg(F.max(F.col("title").rlike(title)).alias("_hit"))
    met = docs.select(key).join(found, key, "left").where("not coalesce(_hit, false)")
    return met.select(key, F.when(F.col("_hit").isNull(), "no text").otherwise("no section of this title").alias("reason"))


def run_sql_file(spark: SparkSession, text: str) -> DataFrame | None:
    """Runs statements separated by semicolons at line ends; gives the last result."""
    out = None
    for statement in text.replace(";\r\n", ";\n").split(";\n"):
        if statement.strip().rstrip(";").strip():
            out = spark.sql(statement.strip().rstrip(";"))
    return out


def read_sql(spark: SparkSession, query: str, values: dict) -> DataFrame:
    """A query with named parameters."""
    return spark.sql(query, args=values)
