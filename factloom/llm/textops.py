"""Vectorised word and shingle hashing, Arrow batch helpers and shared scratch tables.

Texts are handled as UTF-8 bytes. A *word* here is a maximal run of bytes other than
``0x20`` and ``0x09-0x0D``; this equals the code-point definition because none of these
bytes occurs inside a multi-byte character. All hashes are 64-bit, seeded by constants only,
so reruns and other machines agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..scratch import new_folder

#: Bytes of text hashed at once; bounds the working arrays to a few dozen MB.
CHUNK_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; returns a new array."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers derived from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


_TABLE = constants(256, 11)
_TABLE[_SPACE] = 0
_LENGTH = constants(1, 12)[0]
_POWERS = [np.cumprod(np.full(4096, constants(1, 13)[0], np.uint64))]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.full(n, constants(1, 13)[0], np.uint64))
    return _POWERS[0]


class Words:
    """The words of several texts: hashes, byte bounds, and each text's range of words."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stop = np.cumsum(sizes)
        self.first = np.searchsorted(self.start, stop - sizes)
        self.last = np.searchsorted(self.start, stop)
        if len(self.start):
            length = self.end - self.start
            body = raw[~space]
            at = np.cumsum(length) - length
            within = np.arange(len(body)) - np.repeat(at, length)
            weighted = _TABLE[body] * _powers(int(length.max()))[within]
            self.hash = mix(np.add.reduceat(weighted, at) + length.astype(np.uint64) * _LENGTH)
        else:
            self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return self.last - self.first

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; windows that cross texts are the caller's to skip."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = np.zeros(n, np.uint64)
        for j, c in enumerate(constants(k, 100 + k)):
            total += self.hash[j : j + n] * c
        return mix(total)


def chunks(values: list[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of consecutive rows of about `limit` bytes; a longer text stands alone. Null reads as empty."""
    first, size, held = 0, 0, []
    for i, v in enumerate(values):
        v = v or b""
        if held and size + len(v) > limit:
            yield first, held
            first, size, held = i, 0, []
        held.append(v)
        size += len(v)
    if held:
        yield first, held


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c for c, t in zip(columns, schema, strict=True)], schema=schema)


def lower_ascii(texts: Iterable[bytes]) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return [t.lower() for t in texts]


def slim() -> None:
    """Gives freed memory back to the system: Python workers outlive their tasks, and an executor's other workers need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slimming(run):
    """run, for mapInArrow, with slim() after its last batch."""

    def slimmed(batches):
        yield from run(batches)
        slim()

    return slimmed


class Scratch:
    """Intermediate tables written as Parquet to the shared folder; each cuts the lineage before it.

    A lazy result still reads its operator's tables, so only who has consumed it can drop them: see opened() and drop().
    """

    _opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, new_folder(spark, label)
        self.n = 0
        Scratch._opened.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @classmethod
    def opened(cls) -> int:
        """A mark for drop()."""
        return len(cls._opened)

    @classmethod
    def drop(cls, since: int) -> None:
        """Deletes the tables of all that was opened since the mark; their readers must be done."""
        for s in cls._opened[since:]:
            s.delete()
        del cls._opened[since:]

    def delete(self) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))
