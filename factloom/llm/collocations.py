"""Phrase collocations by hierarchical pair naming.

A phrase's name is the place of its first appearance: the smallest (block, number in the block) that holds it, so names are
exact, reruns agree and no table hands them out. Level 1 names frequent words. Level k replaces each two overlapping named
(k-1)-grams by the name of their pair, where the pair is frequent; a pair's two names are its parent pointers, and cuts and
contained phrases are looked up along them.

Plan, for 100 TB. Mappers cut texts into words and close a *block* every few MB: a row with its sequence of
word numbers and its distinct words. At each level a block posts its distinct pairs with their counts, packed by bucket of the pair, so a frequent pair
comes once a block and makes no hot key; a bucket, whose size is bounded by a number of buckets in proportion to the places, adds the counts and
gives names; those of frequent pairs go back to their blocks, which write
the next, shorter sequence. Names join names; nothing is broadcast and nothing of the texts reaches the driver.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textops import Scratch, mix, slim, slimming

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
#: UTF-8 bytes of text after which a block closes, and bytes cut at once.
BLOCK_BYTES, STRETCH = 16 << 20, 1 << 20
#: Bits of a place that number words and pairs of a block; bits above them number blocks.
NUMBER_BITS = 28
#: Blocks of a task at most, as bits.
BLOCK_BITS = 14
#: Places of sequences for each bucket of pairs; a pair has a place at least, so this bounds a bucket.
PLACES = 4 << 20

#: Bytes that end a piece; space and tab part words.
ENDS = b".,;:!?\n\x0b\x0c\r"
_ENDS = bytes.maketrans(ENDS, b"." * len(ENDS))

_POST = [("bucket", pa.int32()), ("body", pa.binary())]
_CUT = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("seq", pa.binary()), ("places", pa.int64()), ("posts", pa.list_(pa.struct(_POST)))])
CUT = "block long, names binary, seq binary, places long, posts array<struct<bucket: int, body: binary>>"
_PARCEL = pa.schema([_POST[0], ("block", pa.int64()), _POST[1]])
PARCEL = "bucket int, block long, body binary"
#: a name (id, its word with lang, or its parents, and its count), or what goes back to a block
_NAMED = pa.schema([("block", pa.int64()), ("body", pa.binary()), ("id", pa.int64()), ("word", pa.binary()), ("left", pa.int64()), ("right", pa.int64()), ("a", pa.int64())])
NAMED = "block long, body binary, id long, word binary, left long, right long, a long"
_SEQUENCE = pa.schema([("block", pa.int64()), ("names", pa.binary()), ("seq", pa.binary()), ("places", pa.int64())])
SEQUENCE = "block long, names binary, seq binary, places long"


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers, byte by byte of each: high bytes are much alike."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())


def _expand(data: bytes, kind=np.int32) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _blob(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


def _parts(blob: bytes, n: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(blob, np.int64, n)) + 8 * n
    return [blob[lo:hi] for lo, hi in zip([8 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def words_of(text: bytes) -> list[bytes]:
    """Words, with b"." wherever a piece ends."""
    return text.lower().translate(_ENDS).replace(b".", b" . ").split()


def stretches(text: bytes, size: int):
    """The text in parts of about `size` bytes, none cut inside a word."""
    lo, n = 0, len(text)
    while n - lo > size:
        hi = lo + size
        while hi < n and text[hi] not in b" \t" and text[hi] not in ENDS:
            hi += 1
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _cut(block_bytes: int, stretch: int, buckets: int):
    def run(batches):
        import zlib

        from pyspark import TaskContext

        task = TaskContext.get()
        first = (task.partitionId() if task else 0) << BLOCK_BITS
        number, size, held = 0, 0, []
        numbers = count(1)
        vocabulary: dict[str, dict[bytes, int]] = {}

        def close():
            if number >> BLOCK_BITS:
                raise ValueError("more blocks than a task can number: raise block_bytes")
            seq = np.concatenate(held)
            held.clear()
            n = np.bincount(seq)[1:]
            if not len(n):
                return
            # frequent words get small numbers: sequences pack better
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(n) + 1, np.int32)
            rank[0], rank[order + 1] = -1, np.arange(len(n))
            by: dict[int, list[tuple[bytes, int, int]]] = {}
            top = len(n)
            for lang, known in vocabulary.items():
                known.pop(b".")
                key, total = lang.encode() + b" ", 0
                for w, i in known.items():
                    times = int(n[i - 1])
                    total += times
                    w = key + w
                    by.setdefault(zlib.crc32(w) % buckets, []).append((w, int(rank[i]), times))
                # the words of a language, all counted: a key without a word
                by.setdefault(zlib.crc32(key) % buckets, []).append((key, top, total))
                top += 1
            posts = [{"bucket": b, "body": _words_out(rows)} for b, rows in by.items()]
            yield pa.RecordBatch.from_pylist([{"block": first + number, "names": b"", "seq": _squeeze(rank[seq]), "places": len(seq), "posts": posts}], _CUT)

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, text = lang.as_py(), text.as_py() or b""
                known = vocabulary.get(lang)
                if known is None:
                    known = vocabulary[lang] = defaultdict(numbers.__next__)
                    known[b"."] = 0
                for part in stretches(text, stretch):
                    found = words_of(part)
                    held.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                held.append(np.zeros(1, np.int32))
                size += len(text)
                if size >= block_bytes:
                    yield from close()
                    number, size, held, numbers, vocabulary = number + 1, 0, [], count(1), {}
        if held:
            yield from close()

    return run


def _words_out(rows: list[tuple[bytes, int, int]]) -> bytes:
    import zstandard

    rows.sort()
    sizes, numbers, n = (np.array(x) for x in zip(*((len(w), i, c) for w, i, c in rows), strict=True))
    return _blob(zstandard.ZstdCompressor(level=3).compress(b"".join([w for w, _, _ in rows])), _squeeze(sizes.astype(np.int32)), _squeeze(numbers.astype(np.int32)), _squeeze(n.astype(np.int64)))


def _words_in(body: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    import zstandard

    words, sizes, numbers, n = _parts(body, 4)
    ends = np.concatenate(([0], np.cumsum(_expand(sizes), dtype=np.int64)))
    data = pa.py_buffer(zstandard.ZstdDecompressor().decompress(words))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), data]), _expand(numbers), _expand(n, np.int64)


def adjacent(seq: np.ndarray, size: int):
    """(places whose number and the next are both names, distinct pairs left * size + right, each place's pair, counts)."""
    a, b = seq[:-1].astype(np.int64), seq[1:]
    both = (a >= 0) & (b >= 0)
    return both, *np.unique(a[both] * size + b[both], return_inverse=True, return_counts=True)


def compact(seq: np.ndarray) -> np.ndarray:
    """Without names that have no neighbour, and with one -1 between runs."""
    live = seq >= 0
    keep = np.zeros(len(seq) + 1, bool)
    pair = live[:-1] & live[1:]
    keep[: len(pair)] |= pair
    keep[1 : len(pair) + 1] |= pair
    keep = keep[: len(seq)]
    take = keep.copy()
    take[1:] |= keep[:-1]
    return np.where(keep, seq, -1)[take]


def _bucket_of(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(right.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)


def _local_pairs(seq: np.ndarray, names: np.ndarray, buckets: int):
    """A block's distinct pairs in order of bucket, left and right, which numbers them: (both, bucket, left, right, each place's pair, counts)."""
    both, found, inverse, n = adjacent(seq, len(names))
    left, right = names[found // max(1, len(names))], names[found % max(1, len(names))]
    bucket = _bucket_of(left, right, buckets)
    order = np.lexsort((right, left, bucket))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    return both, bucket[order], left[order], right[order], number[inverse], n[order]


def _pairs(buckets: int):
    def run(batches):
        for batch in batches:
            for block, names, seq in zip(*(batch.column(i) for i in range(3)), strict=True):
                _, bucket, left, right, _, n = _local_pairs(_expand(seq.as_py()), np.frombuffer(names.as_py(), np.int64), buckets)
                edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
                rows = [
                    {"bucket": int(bucket[lo]), "block": block.as_py(), "body": _blob(np.array([lo], np.int64).tobytes(), _squeeze(np.diff(left[lo:hi], prepend=0)), _squeeze(right[lo:hi]), _squeeze(n[lo:hi]))}
                    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_pylist(rows, _PARCEL)

    return run


def _name(words: bool, least: int):
    """One bucket's posts to names and to what goes back to each block; equal words or pairs of all blocks meet here."""

    def run(group: pa.Table) -> pa.Table:
        blocks, keys, places, counts, sizes = group.column("block").to_pylist(), [], [], [], []
        for block, body in zip(blocks, group.column("body"), strict=True):
            if words:
                key, number, n = _words_in(body.as_py())
            else:
                lo, left, right, n = _parts(body.as_py(), 4)
                n = _expand(n, np.int64)
                key, number = (np.cumsum(_expand(left, np.int64)), _expand(right, np.int64)), np.arange(len(n)) + np.frombuffer(lo, np.int64)[0]
            keys.append(key)
            places.append(number.astype(np.int64) + (block << NUMBER_BITS))
            counts.append(n)
            sizes.append(len(n))
        place, n = np.concatenate(places), np.concatenate(counts)
        if words:
            coded = pa.chunked_array(keys).combine_chunks().dictionary_encode()
            at, distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        else:
            left, right = (np.concatenate([k[i] for k in keys]) for i in (0, 1))
            (_, li), (rs, ri) = np.unique(left, return_inverse=True), np.unique(right, return_inverse=True)
            _, at = np.unique(li * len(rs) + ri, return_inverse=True)
            distinct = int(at.max(initial=-1)) + 1
        a = np.zeros(distinct, np.int64)
        np.add.at(a, at, n)
        name = np.full(distinct, np.iinfo(np.int64).max)
        np.minimum.at(name, at, place)
        often = a[at] >= least
        own = np.flatnonzero(often & (name[at] == place))
        none = pa.nulls(len(own), pa.int64())
        out = [pa.table([none, pa.nulls(len(own), pa.binary()), pa.array(place[own]), coded.dictionary.take(pa.array(at[own])).cast(pa.binary()) if words else pa.nulls(len(own), pa.binary()), none if words else pa.array(left[own]), none if words else pa.array(right[own]), pa.array(a[at[own]])], schema=_NAMED)]
        rows, lo = [], 0
        for block, size in zip(blocks, sizes, strict=True):
            here = np.flatnonzero(often[lo : lo + size]) + lo
            lo += size
            if len(here):
                number = (place[here] & ((1 << NUMBER_BITS) - 1)).astype(np.int32)
                rows.append({"block": block, "body": _blob(_squeeze(np.diff(number, prepend=np.int32(0))), _squeeze(name[at[here]]))})
        out.append(pa.Table.from_pylist(rows, _NAMED))
        done = pa.concat_tables(out)
        slim()
        return done

    return run


def _rename(words: bool, buckets: int):
    """A block's sequence with its words or pairs replaced by their names."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            got = [_parts(body.as_py(), 2) for body in right.column("body")]
            number = np.concatenate([np.cumsum(_expand(x), dtype=np.int64) for x, _ in got])
            names, new = np.unique(np.concatenate([_expand(x, np.int64) for _, x in got]), return_inverse=True)
            seq = _expand(left.column("seq")[0].as_py())
            if words:
                as_name = np.full(max(int(seq.max(initial=0)), int(number.max())) + 2, -1, np.int32)
                as_name[number] = new
                seq = as_name[seq]  # -1 reads the last, which is -1
            else:
                both, _, _, _, pair, n = _local_pairs(seq, np.frombuffer(left.column("names")[0].as_py(), np.int64), buckets)
                as_name = np.full(len(n), -1, np.int32)
                as_name[number] = new
                seq = np.full(len(both), -1, np.int32)
                seq[both] = as_name[pair]
            seq = compact(seq)
            n = np.bincount(seq[seq >= 0], minlength=len(names))
            used = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
            if len(used):
                rank = np.full(len(names) + 1, -1, np.int32)
                rank[used] = np.arange(len(used))
                rows.append({"block": left.column("block")[0].as_py(), "names": names[used].tobytes(), "seq": _squeeze(rank[seq]), "places": len(seq)})
        out = pa.Table.from_pylist(rows, _SEQUENCE)
        slim()
        return out

    return run


def _buckets(sequences: DataFrame) -> int:
    """Buckets of posts: at most PLACES places of text each, and one a shuffle partition at least."""
    (places,) = sequences.agg(F.coalesce(F.sum("places"), F.lit(0))).first()
    return max(int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-places // PLACES))


def _back(sequences: DataFrame, named: DataFrame, words: bool, buckets: int) -> DataFrame:
    """The blocks' next sequences."""
    back = named.where("block is not null").select("block", "body")
    return sequences.select("block", "names", "seq").groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_rename(words, buckets), SEQUENCE)


def _cuts(k: int) -> list[tuple[str, str]]:
    """Columns of the counts before and after each cut of a phrase of k words, in order."""
    return {2: [("f_first", "f_last")], 3: [("f_first", "f_right"), ("f_left", "f_last")], 4: [("f_first", "f_right"), ("f_two", "f_tail"), ("f_left", "f_last")]}[k]


def _grown(named: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """Phrases of k words with all that their parents tell, by joins on the two parent pointers."""
    own = named.where("id is not null").select("id", "left", "right", "a")
    lo = below.select(*[F.col(c).alias(f"l_{c}") for c in below.columns])
    hi = below.select(*[F.col(c).alias(f"r_{c}") for c in below.columns])
    met = own.join(lo, F.col("left") == F.col("l_id")).join(hi, F.col("right") == F.col("r_id"))
    wide = k > 2
    # names are unique within a level
    inner = lambda level, *names: [F.struct(F.lit(level).alias("k"), F.col(c).alias("id")) for c in names]
    within = inner(2, "left", "right") if k == 3 else inner(3, "left", "right") + inner(2, "l_left", "l_right", "r_right")
    return met.select(
        "id", "left", "right", "a", F.col("l_lang").alias("lang"),
        F.concat("l_phrase", F.lit(" "), "r_last").alias("phrase"), F.col("r_last").alias("last"),
        F.col("l_f_first" if wide else "l_a").alias("f_first"), F.col("r_f_last" if wide else "r_a").alias("f_last"),
        F.col("l_a").alias("f_left"), F.col("r_a").alias("f_right"),
        (F.col("l_f_left") if wide else F.lit(None).cast("long")).alias("f_two"), (F.col("r_f_right") if wide else F.lit(None).cast("long")).alias("f_tail"),
        (F.array(*within) if wide else F.array().cast("array<struct<k: int, id: long>>")).alias("within"),
    )


def _scored(grown: DataFrame, k: int) -> DataFrame:
    """With l, r and score of the lowest cut; a product of a count and 2000000 may pass 64 bits, so it is a decimal."""
    wide = "decimal(20,0)"
    cuts = [
        F.struct(F.expr(f"cast(a as {wide}) * 2000000 div (cast({l} as {wide}) + cast({r} as {wide}))").cast("long").alias("score"), F.lit(i).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
        for i, (l, r) in enumerate(_cuts(k))
    ]
    best = grown.withColumn("cut", F.array_min(F.array(*cuts)))
    return best.select(F.struct(F.lit(k).alias("k"), "id").alias("name"), "within", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language by score, a and phrase: in many parts of a language, then in fewer, then in one of bounded size."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for n in (parts, isqrt(parts) + 1, 1):
        part = F.pmod(F.xxhash64("phrase"), F.lit(n))
        rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    return rows.drop("part")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, block_bytes: int = BLOCK_BYTES, stretch: int = STRETCH) -> DataFrame:
    """Each language's `top` phrases of 2 to 4 words by how firmly they hold together: lang, rank, phrase, a, l, r, n, score.

    docs: (lang, text). Texts are lower-cased (A-Z), pieces end at .,;:!? and line ends, words are parted by space and tab. A phrase counts from
    `least` occurrences (a, overlaps included); cut into two parts that occur l and r times it scores floor(2000000 a / (l + r)),
    and its lowest cut counts. Phrases inside a longer candidate that has `covered` percent of their occurrences go. n is the number of words of the language.

    A null language reads as `und`; null and empty texts hold no words; repeated rows count each; other columns are ignored; an empty table
    gives no rows. A very long text passes in stretches and shares a block with others. Ties of the score go by a, then by the phrase's bytes.
    """
    spark = docs.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, Scratch]:
        table = Scratch(spark, "collocations")
        return table.keep(df), table

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sequences, held = keep(given.mapInArrow(slimming(_cut(block_bytes, stretch, parts)), CUT))
    posts = sequences.select("block", F.explode("posts").alias("post")).select("post.bucket", "block", "post.body")
    named, _ = keep(posts.groupBy("bucket").applyInArrow(_name(True, least), NAMED))
    # a key is lang, a space and the word, which holds none
    own = named.where("id is not null").select("id", F.substring_index(F.col("word").cast("string"), " ", -1).alias("w"), F.col("word").cast("string").alias("key"), "a")
    own = own.withColumn("lang", F.expr("substring(key, 1, length(key) - length(w) - 1)"))
    totals = own.where("w = ''").select(F.col("lang").alias("of"), F.col("a").alias("n"))
    below = own.where("w <> ''").select("id", "lang", F.col("w").alias("phrase"), F.col("w").alias("last"), "a")
    (sequences, then), found = keep(_back(sequences, named, True, parts)), []
    held.delete()
    for k in range(2, LONGEST + 1):
        held, buckets = then, _buckets(sequences)
        posts = sequences.select("block", "names", "seq").mapInArrow(slimming(_pairs(buckets)), PARCEL)
        named, _ = keep(posts.groupBy("bucket").applyInArrow(_name(False, least), NAMED))
        below, _ = keep(_grown(named, below, k))
        found.append(_scored(below, k))
        if k < LONGEST:
            sequences, then = keep(_back(sequences, named, False, buckets))
        held.delete()
    every = found[0].unionByName(found[1]).unionByName(found[2])
    # the count of the longer phrase most like it, for each contained phrase
    most = every.select(F.explode("within").alias("inner"), F.col("a").alias("outer")).groupBy("inner").agg(F.max("outer").alias("outer"))
    wide = "decimal(20,0)"
    left = every.join(most, F.col("name") == F.col("inner"), "left").where(f"outer is null or cast(100 as {wide}) * cast(outer as {wide}) < cast({int(covered)} as {wide}) * cast(a as {wide})")
    best = _first(left.select("lang", "phrase", "a", "l", "r", "score"), top)
    return best.join(totals, F.col("lang") == F.col("of")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
