"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers; a block of rows keeps one bitmap for each dimension and bit. A query
adds the slices, shifted by the non-adjacent digits of its own components, with carry-save bitmap
adders: score bits of all rows of a block come out of a few thousand bitwise operations. Top rows are then
selected from the most significant score slice downward; rows equal on all slices are the boundary
and resolve by the smaller vec_id, which is their order in the bitmap.

For 100 TB: blocks hold a bounded number of rows. Queries are packed in slices, and each slice goes to each block -
a query set against all rows. A task holds one block's index and one slice. Blocks return k rows a query, which a window
per query reduces. Nothing is broadcast or collected.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOP, SCALE = 5, 256
#: Rows of a block and queries of a slice, at most.
BLOCK_ROWS, SLICE_QUERIES = 16384, 256

_SCHEMA = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
SCHEMA = "query_id long, vec_id long, score long"


class BlockIndex:
    """Bitmaps (Python integers, bit r = row r) of the rows of one block, in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.lexsort((*values.T[::-1], ids)) if values.size else np.argsort(ids)
        self.ids, values = ids[order], values[order]
        self.n = len(ids)
        self.full = (1 << self.n) - 1
        self.low = int(values.min(initial=0))
        self.bits = max(1, int(values.max(initial=0) - self.low).bit_length())
        shifted = (values - self.low).astype(np.uint64)
        self.slices = []
        for d in range(values.shape[1]):
            col = shifted[:, d]
            self.slices.append([int.from_bytes(np.packbits(((col >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(self.bits)])

    def scores(self, query: list[int]) -> tuple[list[int], int]:
        """(score slices, least first; what to add to the number they spell)."""
        columns: list[list[int]] = [[] for _ in range(self.bits + max((abs(q).bit_length() for q in query), default=0) + len(query).bit_length() + 3)]
        base = 0
        for q, planes in zip(query, self.slices, strict=True):
            base += q * self.low
            at = 0
            while q:  # non-adjacent form: digits -1, 0, 1
                if q & 1:
                    digit = 2 - (q & 3)
                    q -= digit
                    if digit > 0:
                        for b, plane in enumerate(planes):
                            columns[at + b].append(plane)
                    else:  # -v = (complement of v) - (2^bits - 1)
                        for b, plane in enumerate(planes):
                            columns[at + b].append(self.full ^ plane)
                        base -= ((1 << self.bits) - 1) << at
                q >>= 1
                at += 1
        out = []
        for i, column in enumerate(columns):
            while len(column) > 2:
                a, b, c = column.pop(), column.pop(), column.pop()
                ab = a ^ b
                column.append(ab ^ c)
                columns[i + 1].append((a & b) | (c & ab)) if i + 1 < len(columns) else None
            if len(column) == 2:
                a, b = column
                column[:] = [a ^ b]
                columns[i + 1].append(a & b) if i + 1 < len(columns) else None
            out.append(column[0] if column else 0)
        return out, base

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of rows other than query_id, score descending, then id."""
        slices, base = self.scores(query)
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        sure, even = 0, self.full & ~(((1 << int(hi - lo)) - 1) << int(lo))
        k = min(k, even.bit_count())
        for plane in reversed(slices):
            both = sure | (even & plane)
            n = both.bit_count()
            if n >= k:
                even &= plane
            else:
                sure, even = both, even & ~plane
        picked = []
        for bitmap, most in ((sure, k), (even, k - sure.bit_count())):
            while bitmap and most > 0:
                one = bitmap & -bitmap
                picked.append(one.bit_length() - 1)
                bitmap ^= one
                most -= 1
        found = [(int(self.ids[r]), base + sum(((plane >> r) & 1) << i for i, plane in enumerate(slices))) for r in picked]
        return sorted(found, key=lambda x: (-x[1], x[0]))


def _search(k: int):
    def run(batches):
        block, index = None, None
        for batch in batches:
            keys, kinds, widths, ids, values = (batch.column(i).to_pylist() for i in range(5))
            out = []
            for key, kind, width, i, v in zip(keys, kinds, widths, ids, values, strict=True):
                i, v = np.frombuffer(i, np.int64), np.frombuffer(v, np.int64).reshape(-1, width)
                if kind == 0:
                    block, index = key, BlockIndex(i, v)
                elif key == block:
                    for q, row in zip(i.tolist(), v.tolist(), strict=True):
                        out += [(q, vec, score) for vec, score in index.top(q, row, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=_SCHEMA)

    return run


_PACKED = pa.schema([("width", pa.int32()), ("at", pa.int32()), ("ids", pa.binary()), ("vals", pa.binary())])
PACKED = "width int, at int, ids binary, vals binary"


def _pack(group: pa.Table) -> pa.Table:
    width = group.column("width")[0].as_py()
    ids = group.column("id").to_numpy().astype(np.int64)
    flat = pa.concat_arrays([c.flatten() for c in group.column("q").chunks]).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.table([[width], [group.column("at")[0].as_py()], [ids.tobytes()], [flat.tobytes()]], schema=_PACKED)


def top_k(rows: DataFrame, is_query: Column, k: int = TOP, scale: int = SCALE, block_rows: int = BLOCK_ROWS, slice_queries: int = SLICE_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows of `rows` (vec_id, embedding).

    Components become floor(scale * x). Vectors that are null, empty, or hold a null or non-finite component
    take no part, nor do rows without vec_id. A component of 2^62 or more after scaling, and a result's score beyond a
    long, is an error. Vectors meet those of their own length. A query id that
    repeats asks once, with its smallest vector; repeated candidate rows each count. A query without
    candidates gives no row. Extra columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    far = F.raise_error(F.lit("top_k: a scaled component of 2^62 or more has no score that fits a long"))
    x = F.transform("embedding", lambda v: F.when(F.abs(v.cast("double")) * scale < float(1 << 62), F.floor(v.cast("double") * scale)).otherwise(far))
    sound = F.forall("embedding", lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    fit = rows.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & sound)
    fit = fit.select(F.col("vec_id").cast("long").alias("id"), F.size("embedding").alias("width"), x.alias("q"), is_query.alias("asks"))
    sizes = fit.groupBy("width").agg(F.count("*").alias("n"), F.count_if("asks").alias("asks")).collect()  # one row per vector length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = {r["width"]: max(min(parts, math.ceil(r["n"] / 256)), math.ceil(r["n"] / block_rows)) for r in sizes}
    slices = {r["width"]: max(1, math.ceil(r["asks"] / slice_queries)) for r in sizes}
    number = lambda m: F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[F.col("width")]
    dealt = lambda df, m: df.withColumn("at", F.pmod(F.xxhash64("id", "q"), number(m)).cast("int"))
    index = dealt(fit, blocks).select("width", "at", "id", "q").groupBy("width", "at").applyInArrow(_pack, PACKED)
    asked = fit.where("asks").groupBy("width", "id").agg(F.min("q").alias("q"))
    asked = dealt(asked, slices).select("width", "at", "id", "q").groupBy("width", "at").applyInArrow(_pack, PACKED)
    to_all = asked.withColumn("block", F.explode(F.sequence(F.lit(0), number(blocks) - 1)))
    both = index.select(F.struct("width", "at").alias("block"), F.lit(0).alias("kind"), "width", "ids", "vals")
    both = both.unionByName(to_all.select(F.struct("width", F.col("block").alias("at")).alias("block"), F.lit(1).alias("kind"), "width", "ids", "vals"))
    both = both.select(F.concat_ws("-", "block.width", "block.at").alias("block"), "kind", "width", "ids", "vals")
    met = both.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_search(k), SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
