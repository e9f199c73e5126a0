"""The corpus pipeline: toxicity, near-duplicates, substring dedup, source mixing, byte-level BPE.

STAGES lists (name, function); each takes (spark, docs, sf_dir), docs being what the stage before wrote. All but the last
return the columns of docs. SQL can't express the learnt and drawn stages, so ORACLE_SQL is None; tests compare rows of
each stage with brute force or planted cases (tests/llm/test_pipeline_rows.py), encoding with tiktoken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.byte_bpe import encode_decode
from factloom.llm.mixing import mixed_texts
from factloom.llm.near_duplicates import near_duplicates
from factloom.llm.registry import held_out, tokenizer
from factloom.llm.substring_dedup import cut_rows
from factloom.llm.textops import Scratch
from factloom.llm.toxicity import clean_rows

#: Least similarity of the near-duplicates stage, in percent of the union of five-word shingles; op8's 85 binds that query only.
PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows not predicted toxic by their own text, whatever their doc_id."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return clean_rows(docs, labels, ~held_out())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; unlinked documents and those without doc_id stay.

    Where a doc_id holds several texts, each of them is a document, named by a hash of both.
    """
    text = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("__several")).agg(F.min(text).alias("low"), F.max(text).alias("high")).where("low < high").select("__several")
    several = Scratch(spark, "several").keep(several)
    own = docs.join(several, docs.doc_id == several["__several"], "left")
    own = own.withColumn("__own", F.when(F.col("__several").isNotNull(), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long")))
    found = near_duplicates(own.select(F.col("__own").alias("doc_id"), "text"), percent=PERCENT).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return own.join(found, F.col("__own") == F.col("__gone"), "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; text and n_chars of those with repeated windows are what is left, others keep theirs."""
    return cut_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row for each pass over a document that takes words of it, with the words taken."""
    return mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    ranks, pattern = tokenizer()
    return encode_decode(docs.select("doc_id", "text"), ranks, pattern, digest=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing", mix),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read as the next one's docs.

    Once a stage's result is written, the tables it was made from are dropped.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        kept = Scratch(spark, "pipeline")
        mark = Scratch.opened()
        docs = kept.keep(stage(spark, docs, sf_dir))
        Scratch.drop(mark)
        if before is not None:
            before.delete()
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
