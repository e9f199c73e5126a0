"""Incremental ingestion with Structured Streaming: each file once, newest row of a key wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import upsert_newer
from ..scratch import new_folder


def ingest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, keys: list[str], watermark: tuple[str, str] | None = None):
    """Starts a query that appends files of `source` not seen before to `sink`, a key once within the watermark, and stops when it has caught up."""
    rows = spark.readStream.schema(schema).parquet(source)
    if watermark:
        time, lateness = watermark
        # watermarks take timestamps with a zone only
        rows = rows.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", lateness).dropDuplicatesWithinWatermark(keys).drop("_event_time")
    return rows.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(spark: SparkSession, source: str, schema, state: str, checkpoint: str, keys: list[str], by: str):
    """Starts a query that folds new files into versions of a state table: state/v<batch>, the newest row of each key by `by`.

    A version is written beside the one before and never over a path being read; a repeated batch rewrites its own version.
    """

    def fold(batch: DataFrame, number: int) -> None:
        from ..operators.facts import dedup_by

        fresh = dedup_by(batch, keys, [F.col(by).desc_nulls_last(), *[F.col(c) for c in batch.columns if c not in (*keys, by)]])
        if number:
            fresh = upsert_newer(spark.read.schema(batch.schema).parquet(f"{state}/v{number - 1}"), fresh, keys, by)
        fresh.write.mode("overwrite").parquet(f"{state}/v{number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_once(spark: SparkSession, path: str, keys: list[str], time: str, lateness: str) -> DataFrame:
    """Runs ingest() over one table and gives what it wrote: a key once within the watermark."""
    root, schema = new_folder(spark, "ingest"), spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)
    # a file is found by a pattern: a stream's source is a folder or a glob
    ingest(spark, f"{folder}/{name.replace('.parquet', '[.]parquet')}", schema, f"{root}/rows", f"{root}/log", keys, (time, lateness)).awaitTermination()
    return spark.read.schema(schema).parquet(f"{root}/rows")
