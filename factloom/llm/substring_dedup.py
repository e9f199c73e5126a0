"""Exact removal of word windows that already start in a document with a smaller doc_id.

Plan, for 100 TB. Documents are dealt to blocks by a hash of doc_id and text; that exchange moves the
texts once and is reused by all three passes over them:

1. Each block sends its distinct *anchors* (the least 5-word hash inside each 13-word window,
   about one per five words) with their smallest and largest doc_id, packed per hash bucket.
   A bucket tells each block which of its anchors more than one document holds. Equal windows
   have equal anchors, so other windows can't repeat.
2. Each block sends the distinct windows over shared anchors with their smallest doc_id. A
   bucket answers only blocks for which a smaller doc_id exists elsewhere.
3. Each block marks windows whose owner is smaller than the document and drops covered words.

What is sent is distinct per block, so a passage held by a third of all documents costs one
entry a block and no task gathers its holders. Memory is bounded by a block or a bucket, whose
number follows spark.sql.shuffle.partitions. Windows are compared as 64-bit hashes of all
their words; n distinct windows meet a false match with probability about n^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .textops import Words, slim

WINDOW, GRAM = 13, 5
#: Blocks for each shuffle partition. There is one bucket a partition: a block sends each bucket a row, so more would multiply rows.
SPREAD = 4
_LAST = np.iinfo(np.int64).max


def pack(a: np.ndarray) -> bytes:
    """Byte planes of a 64-bit array: planes of sorted or small numbers compress well in the shuffle."""
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(b: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _texts(group: pa.Table) -> tuple[np.ndarray, Words, list[bytes]]:
    ids = np.array([_LAST if i is None else i for i in group.column("doc_id").to_pylist()], np.int64)
    texts = [t or b"" for t in group.column("text").to_pylist()]
    return ids, Words(texts), texts


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    step = 1
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: n], x[rest : rest + n])


def _inside(words: Words, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the row of each."""
    rows = np.repeat(np.arange(len(words.first)), np.maximum(0, words.counts() - width + 1))
    starts = np.concatenate([np.arange(a, b - width + 1) for a, b in zip(words.first, words.last, strict=True)] or [np.zeros(0, np.int64)])
    return starts.astype(np.int64), rows


def _extremes(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest and largest id."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    end = np.concatenate((new[1:], [True])) if len(keys) else new
    return keys[new], ids[new], ids[end]


def _by_bucket(keys: np.ndarray, buckets: int, *more: np.ndarray):
    """Keys are sorted, so a bucket is a slice: (bucket, slices)."""
    width = (1 << 64) // buckets + 1
    edges = np.searchsorted(keys, np.array([min(b * width, (1 << 64) - 1) for b in range(1, buckets)], np.uint64))
    lo = 0
    for b, hi in enumerate([*edges.tolist(), len(keys)]):
        if hi > lo:
            yield b, keys[lo:hi], *(m[lo:hi] for m in more)
        lo = hi


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])
_BACK = pa.schema([("block", pa.int32()), ("keys", pa.binary()), ("low", pa.binary())])
_DONE = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
SENT, BACK, DONE = "bucket int, block int, keys binary, low binary, high binary", "block int, keys binary, low binary", "doc_id long, n_words long, n_removed long, kept_text string"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


def _anchors(words: Words, width: int, gram: int) -> np.ndarray:
    return _least(words.windows(gram), width - gram + 1)


def _send_anchors(width: int, gram: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        ids, words, _ = _texts(group)
        block = group.column("block")[0].as_py()
        anchors = _anchors(words, width, gram)
        starts, rows = _inside(words, width, len(anchors))
        found = _extremes(anchors[starts], ids[rows])
        return _rows([(b, block, pack(k), pack(lo), pack(hi)) for b, k, lo, hi in _by_bucket(found[0], buckets, *found[1:])], _SENT)

    return run


def _gathered(group: pa.Table):
    blocks = group.column("block").to_pylist()
    keys = [unpack(x, np.uint64) for x in group.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    low = np.concatenate([unpack(x, np.int64) for x in group.column("low").to_pylist()])
    return np.repeat(np.array(blocks, np.int32), sizes), np.concatenate(keys), low


def _to_blocks(block: np.ndarray, keys: np.ndarray, low: np.ndarray | None) -> pa.Table:
    order = np.lexsort((keys, block))
    block, keys = block[order], keys[order]
    low = low[order] if low is not None else None
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True]))) if len(block) else np.zeros(1, int)
    return _rows([(int(block[a]), pack(keys[a:b]), pack(low[a:b]) if low is not None else b"") for a, b in zip(cut[:-1], cut[1:], strict=True)], _BACK)


def _shared(group: pa.Table) -> pa.Table:
    """Which anchors are held by more than one document, to each block that sent them."""
    block, keys, low = _gathered(group)
    high = np.concatenate([unpack(x, np.int64) for x in group.column("high").to_pylist()])
    names, at = np.unique(keys, return_inverse=True)
    least, most = np.full(len(names), _LAST), np.full(len(names), -_LAST - 1)
    np.minimum.at(least, at, low)
    np.maximum.at(most, at, high)
    keep = (least < most)[at]
    return _to_blocks(block[keep], keys[keep], None)


def _owners(group: pa.Table) -> pa.Table:
    """The smallest holder of each window, to each block whose own holders are all larger."""
    block, keys, low = _gathered(group)
    names, at = np.unique(keys, return_inverse=True)
    least = np.full(len(names), _LAST)
    np.minimum.at(least, at, low)
    keep = least[at] < low
    return _to_blocks(block[keep], keys[keep], least[at][keep])


def _answers(back: pa.Table) -> np.ndarray:
    found = [unpack(x, np.uint64) for x in back.column("keys").to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _member(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    if not len(names):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return names[at] == x


def _send_windows(width: int, gram: int, buckets: int):
    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not group.num_rows or not back.num_rows:
            return _rows([], _SENT)
        ids, words, _ = _texts(group)
        block = group.column("block")[0].as_py()
        starts, rows = _inside(words, width, 0)
        hit = _member(_anchors(words, width, gram)[starts], np.sort(_answers(back)))
        windows = words.windows(width)[starts[hit]]
        found = _extremes(windows, ids[rows[hit]])
        return _rows([(b, block, pack(k), pack(lo), b"") for b, k, lo in _by_bucket(found[0], buckets, found[1])], _SENT)

    return run


def _remove(width: int, carry: pa.DataType | None = None):
    """Rows of DONE; with `carry`, the type of the column row, (text, n_removed, row), text as it was where nothing is removed."""

    def run(group: pa.Table, back: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _rows([], _DONE if carry is None else pa.schema([("text", pa.binary()), ("n_removed", pa.int64()), ("row", carry)]))
        ids, words, texts = _texts(group)
        starts, rows = _inside(words, width, 0)
        windows = words.windows(width)[starts]
        names, own, _ = _extremes(windows, ids[rows])
        if back.num_rows:
            keys = _answers(back)
            low = np.concatenate([unpack(x, np.int64) for x in back.column("low").to_pylist()])
            at = np.searchsorted(names, keys)
            own[at] = np.minimum(own[at], low)
        gone = np.zeros(len(words.hash) + 1, np.int64)
        if len(starts):
            repeated = starts[own[np.searchsorted(names, windows)] < ids[rows]]
            gone[repeated] += 1
            np.subtract.at(gone, repeated + width, 1)
        gone = np.cumsum(gone)[:-1] > 0
        out = []
        data, given = words.data, group.column("doc_id").to_pylist()
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
            kept = np.flatnonzero(~gone[a:b]) + a
            text = b" ".join([data[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])
            out.append((given[i], b - a, b - a - len(kept), text.decode() if carry is None else text))
        if carry is not None:
            was = group.column("text").to_pylist()
            cut = pa.array([o[3] if o[2] else t for o, t in zip(out, was, strict=True)], pa.binary())
            return pa.table({"text": cut, "n_removed": pa.array([o[2] for o in out], pa.int64()), "row": group.column("row")})
        return _rows(out, _DONE)

    return run


def remove_repeated_windows(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_text.

    A word goes if a window of `width` words that covers it also starts in a row with a smaller
    doc_id; rows of one doc_id never remove each other's words. kept_text joins the kept words by
    one space (empty for null, empty, blank and fully removed texts). A null doc_id counts as
    larger than all others. Extra columns are ignored; an empty table gives no rows.
    """
    return _by_blocks(docs, width, gram, _remove(width), DONE)


def cut_rows(docs: DataFrame, width: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs, with all their columns; text and n_chars of a row that loses words are those of its own kept_text."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")
    kind = docs.select(rest).schema["row"].dataType
    schema = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("row", kind)])
    done = _by_blocks(docs, width, gram, _remove(width, to_arrow_type(kind)), schema, rest)
    text = F.col("text").cast(docs.schema["text"].dataType)
    new = {"text": text}
    if "n_chars" in docs.columns:
        was = F.col("row").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(was)
    return done.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _slimmed(run):
    def slimmed(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            slim()

    return slimmed


def _slimmed2(run):
    def slimmed(group: pa.Table, back: pa.Table) -> pa.Table:
        try:
            return run(group, back)
        finally:
            slim()

    return slimmed


def _by_blocks(docs: DataFrame, width: int, gram: int, remove, schema, *more: Column) -> DataFrame:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = SPREAD * parts, parts
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    # rows of one doc_id never remove each other's words, so they need not meet: neither it nor null makes a hot block
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = dealt.groupBy("block")
    shared = by_block.applyInArrow(_slimmed(_send_anchors(width, gram, buckets)), SENT).groupBy("bucket").applyInArrow(_shared, BACK)
    windows = by_block.cogroup(shared.groupBy("block")).applyInArrow(_slimmed2(_send_windows(width, gram, buckets)), SENT)
    owners = windows.groupBy("bucket").applyInArrow(_owners, BACK)
    return by_block.cogroup(owners.groupBy("block")).applyInArrow(_slimmed2(remove), schema)
