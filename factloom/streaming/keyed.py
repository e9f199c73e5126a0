"""Newest row of each key, folded from a stream of files with keyed state: work follows the batch, not the table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegralType, MapType, StructField, StructType, VariantType

from ..operators.facts import dedup_by
from ..scratch import delete

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """Holds each key's place in the order and its row; gives the row whenever a newer one has come.

    A timer drops the state of a key once the watermark has passed its newest time: whatever still counts is newer. Each key of a batch costs some
    calls between Python and the state store, so only a fold with a lateness bound goes this way.
    """

    def __init__(self, keys: list[str], by: str, held: StructType):
        self.keys, self.by, self.held = keys, by, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("newest", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [f.name for f in self.held]
        now = self.state.get() if self.state.exists() else None
        best, fresh = None if now is None else tuple(now), False
        whole_numbers = [isinstance(f.dataType, IntegralType) for f in self.held]
        for frame in rows:
            for row in frame[names].itertuples(index=False, name=None):
                # nulls make pandas read whole numbers as floats
                row = tuple(None if v is pd.NaT or v is pd.NA or v is None or v != v else int(v) if whole else v for v, whole in zip(row, whole_numbers, strict=True))
                if best is None or self._order(row) > self._order(best):
                    best, fresh = row, True
        if fresh:
            self.state.update(best)
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(pd.Timestamp(best[0]).timestamp() * 1000) + 1)
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{n: [v] for n, v in zip(names, best, strict=True)}})

    def _order(self, row: tuple) -> tuple:
        """By the order's column, then by the others as text, so that the order of arrival never matters; nulls first."""
        return (row[0] is not None, row[0] if row[0] is not None else 0, *[(v is not None, str(v)) for v in row[1:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def _newest_of(rows: DataFrame, keys: list[str], by: str, rest: list[StructField]) -> DataFrame:
    """Each key's newest row so far, as a streaming aggregate; of a batch's keys, those whose newest row came with this batch.

    A row carries its batch's time, which a repeated batch takes from the log. Of equal rows the one with the least time stays, so a row
    that was there before does not count as new.
    """
    now = F.unix_millis(F.current_timestamp())

    def place(f: StructField):
        if isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)):
            return F.to_json(F.struct(f.name)).alias(f.name)
        return F.struct(F.col(f.name).cast("string").alias("text"), F.col(f.name).alias("value")).alias(f.name)

    order = F.struct(by, *[place(f) for f in rest], (-F.col("_batch_time")).alias("_batch_time"))
    newest = rows.withColumn("_batch_time", now).groupBy(*keys).agg(F.max_by(F.struct(by, *[f.name for f in rest], "_batch_time"), order).alias("_newest"))
    return newest.where(F.col("_newest._batch_time") == now).select(*keys, "_newest.*").drop("_batch_time")


def fold_newest(spark: SparkSession, source: str, schema: StructType, changes: str, checkpoint: str, keys: list[str], by: str, lateness: str | None = None, files_per_batch: int | None = None):
    """Starts a query that folds new files of `source` into the newest row of each key by `by`, and stops when it has caught up; newest() reads the table.

    Each batch writes the rows that changed to changes/batch=<n>, and a repeated batch writes its folder again, so a restart from the checkpoint changes nothing. Late,
    repeated and out-of-order files give what one fold over all of them would; rows of equal `by` go by their other columns. With `lateness`, `by` is an event time: rows
    further behind the newest than that are left out, and the state of settled keys is dropped.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    rest = [f for f in schema if f.name not in (*keys, by)]
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source)
    if lateness:
        held = StructType([StructField(f.name, f.dataType, True) for f in (schema[by], *rest)])
        out = StructType([*[schema[k] for k in keys], *held.fields])
        found = rows.withWatermark(by, lateness).groupBy(*keys).transformWithStateInPandas(Newest(keys, by, held), outputStructType=out, outputMode="Append", timeMode="EventTime")
    else:
        found = _newest_of(rows, keys, by, rest)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

    return found.writeStream.outputMode("append" if lateness else "update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, schema: StructType, changes: str, keys: list[str]) -> DataFrame:
    """The table that fold_newest's changes amount to: each key's last change."""
    names = [f.name for f in schema]
    every = spark.read.schema(StructType([*schema.fields, StructField("batch", _long())])).option("basePath", changes).parquet(f"{changes}/batch=*")
    return dedup_by(every, keys, [F.col("batch").desc()]).select(*names)


def _long():
    from pyspark.sql.types import LongType

    return LongType()


def compact(spark: SparkSession, schema: StructType, changes: str, keys: list[str]) -> None:
    """Folds all changes but the last batch's into that batch's predecessor, so that reading costs the table and one batch. No query may run meanwhile.

    The folded table is written beside the changes first and then takes the place of the folder it replaces; older folders go last, so a stop
    in between leaves every key's last change in place.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(changes).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    numbers = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path(changes)) if s.getPath().getName().startswith("batch="))
    if len(numbers) < 3:
        return
    old = numbers[:-1]
    every = spark.read.schema(StructType([*schema.fields, StructField("batch", _long())])).option("basePath", changes).parquet(*[f"{changes}/batch={n}" for n in old])
    folded = dedup_by(every, keys, [F.col("batch").desc()]).select(*[f.name for f in schema])
    folded.write.mode("overwrite").parquet(f"{changes}/_folded")
    delete(spark, f"{changes}/batch={old[-1]}")
    fs.rename(path(f"{changes}/_folded"), path(f"{changes}/batch={old[-1]}"))
    for n in old[:-1]:
        delete(spark, f"{changes}/batch={n}")
