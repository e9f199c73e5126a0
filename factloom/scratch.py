"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


@atexit.register
def _forget() -> None:
    if "dir" in _LOCAL:
        shutil.rmtree(_LOCAL["dir"], ignore_errors=True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local folder in local mode (tests), an error elsewhere: executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="factloom-"))
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """Tables of an iteration, written as Parquet so that lineage stays one round long."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n, self.gone = spark, new_folder(spark, label), 0, 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, kept: int = 1) -> None:
        """Deletes all but the last tables kept; nothing may read them any more."""
        for n in range(self.gone + 1, self.n - kept + 1):
            delete(self.spark, f"{self.root}/{n}")
        self.gone = max(self.gone, self.n - kept)
