"""Byte-level BPE: pre-tokens by position, each distinct pre-token encoded once, ids joined back.

Plan, for 100 TB. Mappers cut texts into pre-tokens and close a *block* every few MB. A block
sends its distinct pre-tokens (sorted, hence well compressed, with their places in the block's
vocabulary) to word buckets by a hash of the word, and its sequence of positions in parcels of
bounded size, each to the bucket of a hash of its own name. A bucket sees a word once per block, not once per
occurrence, so frequent words make no hot key; it encodes each distinct word once and returns the
ids to the block. There ids are put at their positions, texts are cut at document bounds, and decoding
looks ids up in the token-byte table. Two exchanges; no text leaves the mapper. Tasks take and give
one row at a time, and rows are bounded. A text's pre-tokens are read, encoded and
hashed in stretches, so a very long text costs its bytes and four more for each pre-token.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slim, slimming

#: UTF-8 bytes of text after which a block closes.
BLOCK_BYTES = 16 << 20
#: Places of a parcel, and pre-tokens handled at once.
STRETCH = 1 << 20
#: Bytes of distinct words that an encoding worker remembers.
KNOWN_BYTES = 48 << 20
#: The code points of Unicode's White_Space property, which Rust's \s means (Python's has four more).
WHITE_SPACE = r"\t-\r\x20\x85\xa0  -     　"

_PART = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.string()), ("part", pa.int32()), ("body", pa.binary())])
PART = "kind int, bucket int, block string, part int, body binary"
_DONE = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
DONE = "doc_id long, ids array<int>, decoded binary"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_WORDS, _PLACES = 0, 1


def rust_space(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out as Rust reads them."""
    return pattern.replace(r"[^\s", f"[^{WHITE_SPACE}").replace(r"\S", f"[^{WHITE_SPACE}]").replace(r"\s", f"[{WHITE_SPACE}]")


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: the adjacent pair of least rank merges first, the leftmost among equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    while True:
        best, at = None, -1
        for i, r in enumerate(pairs):
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1])
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge(), with a heap over a linked list: n log n for very long pre-tokens."""
    import heapq

    n = len(word)
    part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(joined := part[i] + part[j])) is not None:
            heapq.heappush(heap, (r, i, joined))

    for i in range(n):
        offer(i)
    while heap:
        _, i, joined = heapq.heappop(heap)
        if part[i] is None or after[i] >= n or part[i] + part[after[i]] != joined:
            continue
        j = after[i]
        part[i], part[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[p] for p in part if p is not None]


def _blob(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _parts(blob: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(blob, np.int64, n).tolist()
    out, at = [], 8 * n
    for s in sizes:
        out.append(blob[at : at + s])
        at += s
    return out


def _squeezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def _unsqueezed(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _one(row: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _PART, strict=True)], schema=_PART)


def _cut(pattern: str, buckets: int, block_bytes: int, stretch: int):
    def run(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern)
        task = TaskContext.get()
        name, count = f"{task.stageId()}-{task.partitionId()}" if task else "0", 0
        ids, lengths, seen, places, size = [], [], {}, [], 0

        def close():
            block = f"{name}-{count}"
            words = [w.encode() for w in seen]
            by: dict[int, list[int]] = {}
            for i in sorted(range(len(words)), key=words.__getitem__):
                by.setdefault(zlib.crc32(words[i]) % buckets, []).append(i)
            for b, at in by.items():
                yield _one((_WORDS, b, block, 0, _blob(front([words[i] for i in at]), _numbers(at))))
            named = pa.array(ids, pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).tobytes()
            heads = _blob(_squeezed(named), bytes(i is None for i in ids), np.array(lengths, np.int64).tobytes(), np.array([len(seen)], np.int64).tobytes())
            flat = np.concatenate(places) if places else np.zeros(0, np.uint32)
            known = 0
            for k, lo in enumerate(range(0, max(1, len(flat)), stretch)):
                part = flat[lo : lo + stretch]
                body = _blob(heads if k == 0 else b"", squeeze(part, len(seen), known))
                known = max(known, int(part.astype(np.int64).max(initial=-1)) + 1)
                yield _one((_PLACES, zlib.crc32(f"{block}-{k}".encode()) % buckets, block, k, body))

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                i, text, n = i.as_py(), text.as_py() or "", 0
                found = find.finditer(text) if len(text) > stretch else iter(find.findall(text))
                while len(held := [seen.setdefault(w if isinstance(w, str) else w.group(), len(seen)) for w in islice(found, stretch)]):
                    places.append(np.array(held, np.uint32))
                    n += len(held)
                ids.append(i)
                lengths.append(n)
                size += len(text.encode())
                if size >= block_bytes:
                    yield from close()
                    count += 1
                    ids, lengths, seen, places, size = [], [], {}, [], 0
        if ids:
            yield from close()

    return run


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel()


def _numbers(a) -> bytes:
    return _squeezed(_planes(np.asarray(a, np.uint32)))


def _array(b: bytes) -> np.ndarray:
    return _unplanes(_unsqueezed(b))


def front(words: list[bytes]) -> bytes:
    """Sorted words, each as the length of the prefix it shares with the one before and its other bytes."""
    shared, sizes, rest, last = [], [], [], b""
    for w in words:
        k, most = 0, min(len(last), len(w))
        while k < most and last[k] == w[k]:
            k += 1
        shared.append(k)
        sizes.append(len(w) - k)
        rest.append(w[k:])
        last = w
    return _blob(_numbers(shared), _numbers(sizes), _squeezed(b"".join(rest)))


def unfront(blob: bytes) -> Iterator[bytes]:
    shared, sizes, rest = _parts(blob, 3)
    rest, at, last = _unsqueezed(rest), 0, b""
    for k, n in zip(_array(shared).tolist(), _array(sizes).tolist(), strict=True):
        last = last[:k] + rest[at : at + n]
        at += n
        yield last


def squeeze(places: np.ndarray, n: int, known: int) -> bytes:
    """Places in a vocabulary of n words numbered by first occurrence, the first `known` of which occurred before, in few bytes.

    One byte a place: one of the 254 most frequent words, 254 for a word's first occurrence (whose number follows), or 255
    for another word, whose number stands in a second stream.
    """
    common = np.argsort(-np.bincount(places, minlength=n), kind="stable")[:254]
    code = np.full(n, 255, np.uint8)
    code[common] = np.arange(len(common))
    out = code[places]
    found, at = np.unique(places, return_index=True)
    out[at[found >= known]] = 254
    return _blob(common.astype(np.uint32).tobytes(), _squeezed(out.tobytes()), _numbers(places[out == 255]), np.array([known], np.int64).tobytes())


def expand(blob: bytes) -> np.ndarray:
    common, codes, rest, known = _parts(blob, 4)
    codes = np.frombuffer(_unsqueezed(codes), np.uint8)
    out = np.concatenate((np.frombuffer(common, np.uint32), np.zeros(256, np.uint32)))[codes]
    new = codes == 254
    out[new] = np.arange(new.sum()) + np.frombuffer(known, np.int64)[0]
    out[codes == 255] = _array(rest)
    return out


def _encode(table) -> object:
    def run(batches):
        ranks, known, held = table.value, {}, 0
        for batch in batches:
            for kind, bucket, block, part, body in zip(*(batch.column(i) for i in range(5)), strict=True):
                kind, body = kind.as_py(), body.as_py()
                if kind == _WORDS:
                    words, at = _parts(body, 2)
                    ids, counts = [], []
                    for w in unfront(words):
                        if (got := known.get(w)) is None:
                            if held > KNOWN_BYTES:
                                known, held = {}, 0
                            got = known[w] = tuple(merge(w, ranks))
                            held += 200 + len(w) + 8 * len(got)
                        ids += got
                        counts.append(len(got))
                    body = _blob(_numbers(ids), _numbers(counts), at)
                yield _one((kind, bucket.as_py(), block.as_py(), part.as_py(), body))

    return run


def _assemble(table, digest: bool, stretch: int):
    def run(group: pa.Table) -> pa.Table:
        spelled = {i: t for t, i in table.value.items()}
        parcels: dict[int, bytes] = {}
        vocabulary: list[list[int]] = []
        for kind, part, body in zip(group.column("kind"), group.column("part"), group.column("body"), strict=True):
            if kind.as_py() == _PLACES:
                head, packed = _parts(body.as_py(), 2)
                parcels[part.as_py()] = packed
                if head:
                    docs, null, lengths, size = _parts(head, 4)
                    vocabulary += [[]] * (int(np.frombuffer(size, np.int64)[0]) - len(vocabulary))
                continue
            flat, counts, at = (_array(x) for x in _parts(body.as_py(), 3))
            flat, lo = flat.tolist(), 0
            vocabulary += [[]] * (int(at.max()) + 1 - len(vocabulary))
            for i, n in zip(at.tolist(), counts.tolist(), strict=True):
                vocabulary[i] = flat[lo : lo + n]
                lo += n
        digits = [b",".join(b"%d" % t for t in ids) for ids in vocabulary] if digest else []
        raw = [b"".join([spelled[t] for t in ids]) for ids in vocabulary]
        sizes = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        places = np.concatenate([expand(parcels[k]) for k in range(len(parcels))])
        schema = _DIGEST if digest else _DONE
        out, lo = [], 0
        for doc, none, n in zip(np.frombuffer(_unsqueezed(docs), np.int64).tolist(), null, np.frombuffer(lengths, np.int64).tolist(), strict=True):
            here = places[lo : lo + n]
            lo += n
            doc = None if none else doc
            if digest:
                ids, text = hashlib.sha256(), hashlib.sha256()
                for a in range(0, n, stretch):
                    at = here[a : a + stretch].tolist()
                    ids.update((b"," if a else b"") + b",".join([digits[i] for i in at]))
                    text.update(b"".join([raw[i] for i in at]))
                out.append((doc, int(sizes[here].sum()), ids.hexdigest(), text.hexdigest()))
            else:
                at = here.tolist()
                out.append((doc, [t for i in at for t in vocabulary[i]], b"".join([raw[i] for i in at])))
        done = pa.table([pa.array([r[i] for r in out], t.type) for i, t in enumerate(schema)], schema=schema)
        del vocabulary, digits, raw, parcels, places, out
        slim()
        return done

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, digest: bool = False, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """One row per row of docs (doc_id, text): ids and the bytes decoded from them, or with `digest` their sha-256 sums.

    The driver reads the rank file and broadcasts it (its size is fixed by the vocabulary).
    Null and empty texts have no tokens. Repeated rows and doc_ids stay apart; a null doc_id stays
    null. Extra columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(load_ranks(ranks_path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(slimming(_cut(rust_space(pattern), 2 * parts, block_bytes, stretch)), PART)
    encoded = cut.repartition(parts, "bucket").mapInArrow(slimming(_encode(table)), PART)
    return encoded.groupBy("block").applyInArrow(_assemble(table, digest, stretch), DIGEST if digest else DONE)
