"""Company overviews over HTTP as a data source: planned partitions, one spacing of requests over all of them, retries and a failure column.

Time is cut into slots of the spacing, and partition i of n sends only at the start of a slot whose number leaves i when divided by n. So no two requests
of any partitions fall into one slot, whenever tasks start and however many run at once, and nothing has to be shared but the clock. A task that is lost sends its own
keys again and no others.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed value: seconds between requests.
SPACING = 12.5
SCHEMA = "key string, status int, body string, failure string, attempts int"
#: Answers after which a request is worth another try.
_AGAIN = frozenset((429, 500, 502, 503, 504))


class Slots:
    """Waits for the slots of one partition."""

    def __init__(self, spacing: float, part: int, parts: int, clock=time.time, sleep=time.sleep):
        self.spacing, self.part, self.parts, self.clock, self.sleep, self.last = spacing, part, parts, clock, sleep, -1

    def wait(self) -> None:
        slot = int(self.clock() / self.spacing) + 1
        slot = max(slot, self.last + 1)
        slot += (self.part - slot) % self.parts
        self.last = slot
        while (left := slot * self.spacing - self.clock()) > 0:
            self.sleep(left)


def fetch(keys: Iterable[str], url: str, slots: Slots, attempts: int, timeout: float) -> Iterator[tuple]:
    """(key, status, body, failure, attempts) of each key: failure says what went wrong at the last try, null where an answer came."""
    for key in keys:
        status = body = failure = None
        tried = 0
        while tried < attempts:
            slots.wait()
            tried += 1
            status = body = None
            try:
                with urllib.request.urlopen(url.replace("{key}", urllib.parse.quote(key, safe="")), timeout=timeout) as answer:
                    status, body, failure = answer.status, answer.read().decode("utf-8", "replace"), None
                break
            except urllib.error.HTTPError as e:
                status, failure = e.code, f"HTTP {e.code}"
                if e.code not in _AGAIN:
                    break
            except (OSError, ValueError) as e:
                failure = f"{type(e).__name__}: {e}"
        yield key, status, body, failure, tried


class _Keys(InputPartition):
    def __init__(self, part: int, parts: int, keys: list[str]):
        super().__init__(part)
        self.part, self.parts, self.keys = part, parts, keys


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url = options["url"]
        if "{key}" not in self.url:
            raise ValueError("url must hold {key}")
        self.keys = list(dict.fromkeys(json.loads(options["keys"])))
        self.spacing, self.attempts = float(options.get("spacing", SPACING)), int(options.get("attempts", 3))
        self.timeout, self.parts = float(options.get("timeout", 30)), max(1, min(int(options.get("partitions", 1)), len(self.keys) or 1))

    def partitions(self) -> list[InputPartition]:
        return [_Keys(i, self.parts, self.keys[i :: self.parts]) for i in range(self.parts)]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        yield from fetch(partition.keys, self.url, Slots(self.spacing, partition.part, partition.parts), self.attempts, self.timeout)


class Overviews(DataSource):
    """spark.read.format("overviews"). Options: url with {key} in it, keys (a JSON list), and spacing, partitions, attempts, timeout."""

    @classmethod
    def name(cls) -> str:
        return "overviews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_overviews(spark: SparkSession, url: str, keys: list[str], **options: object) -> DataFrame:
    """The overviews of a list of keys, each asked for once: key, status, body, failure, attempts. For keys that fit an option; see fetch_overviews for a table of keys."""
    spark.dataSource.register(Overviews)
    given = {k: str(v) for k, v in options.items()}
    return spark.read.format("overviews").options(url=url, keys=json.dumps(keys), **given).load()


def fetch_overviews(keys: DataFrame, key: str, url: str, partitions: int, spacing: float = SPACING, attempts: int = 3, timeout: float = 30) -> DataFrame:
    """As read_overviews, for a table of keys, whose distinct values are dealt to `partitions` tasks. Null keys are left out.

    Every evaluation asks again: write the result before it is used.
    """

    def run(frames):
        import pandas as pd
        from pyspark import TaskContext

        slots = Slots(spacing, TaskContext.get().partitionId(), partitions)
        for frame in frames:
            for row in fetch(frame["key"], url, slots, attempts, timeout):
                yield pd.DataFrame([row], columns=["key", "status", "body", "failure", "attempts"]).astype({"status": "Int32"})

    own = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct().repartition(partitions, "key")
    return own.mapInPandas(run, SCHEMA)
