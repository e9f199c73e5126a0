"""Order MinHash fingerprints, in DataFrame functions only.

A text's k-mers of K words are numbered by occurrence (the second "of the" is not the first).
Numbered k-mers are hashed; the hash space is split into 2 * SKETCHES parts and the least member of each part is
selected. A sketch takes two parts' members in the order in which they stand in the text and hashes the
pair, so it keeps the order that plain MinHash loses. Two texts' likeness is the square root of
the share of equal sketches (a pair survives if both members do), counted over sketches that either text has.

For 100 TB: the fingerprint is an expression on one row - no explode, no aggregation, no shuffle. Hash, part and place are
packed in one long, so both sorts are primitive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textops import Scratch

K, SKETCHES = 2, 32
#: Bits for a word's place; a text of more than 2^26 words has its places in units of as many words as that takes.
_PLACE = 26


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(text: Column, k: int = K, sketches: int = SKETCHES, place_bits: int = _PLACE) -> Column:
    """array<bigint> of `sketches` hashes, null where neither part has a member.

    Words are separated by the characters 0x20 and 0x09-0x0D. Fewer than k words make one k-mer;
    null, empty and blank texts have a fingerprint of nulls. Equal texts have equal fingerprints. Every word of a text of any length enters:
    beyond 2^place_bits words, selected k-mers less than a place's unit apart count as in hash order.
    """
    parts = 2 * sketches
    top, mask = (parts - 1).bit_length(), (1 << place_bits) - 1
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def hashed(w: Column) -> Column:
        # k-mer hash in the high bits, place in the low ones; sorted, equal k-mers stand together in text order
        last = F.greatest(F.size(w) - k, F.lit(0))
        kmer = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)])
        at = lambda place: F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.shiftleft(F.shiftrightunsigned(kmer(i), place_bits), place_bits).bitwiseOR(place(i).cast("long"))))
        unit = F.ceil(F.size(w) / (mask + 1))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) <= mask + 1, at(lambda i: i)).otherwise(at(lambda i: F.floor(i / unit)))

    def numbered(p: Column) -> Column:
        # runs of one k-mer: (first index of each), then every member's number in its run enters its hash
        n = F.size(p)
        same = lambda a, b: F.shiftrightunsigned(a, place_bits) == F.shiftrightunsigned(b, place_bits)
        new = F.filter(F.transform(p, lambda x, i: F.when((i > 0) & same(x, F.get(p, i - 1)), F.lit(-1)).otherwise(i)), lambda i: i >= 0)

        def runs(starts: Column) -> Column:
            member = lambda s, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.shiftrightunsigned(F.get(p, i), place_bits), i - s), place_bits), place_bits).bitwiseOR(F.get(p, i).bitwiseAND(F.lit(mask)))
            return F.flatten(F.transform(starts, lambda s, j: F.transform(F.sequence(s, F.coalesce(F.get(starts, j + 1), n) - 1), lambda i: member(s, i))))

        return F.when(n > 0, _let(new, runs)).otherwise(p)

    part = lambda x: F.shiftrightunsigned(x, 64 - top).cast("int")
    least = lambda s: F.filter(s, lambda x, i: (i == 0) | (part(x) != part(F.get(s, i - 1))))

    def sketch(m: Column) -> Column:
        # m: the least member of each part that has one, in part order as unsigned numbers
        of = F.map_from_entries(F.transform(m, lambda x: F.struct(part(x), x)))

        def pairs(t: Column) -> Column:
            def one(j: Column) -> Column:
                a, b = F.try_element_at(t, 2 * j), F.try_element_at(t, 2 * j + 1)
                place = lambda x: x.bitwiseAND(F.lit(mask))
                name = lambda x: F.shiftrightunsigned(x, place_bits)
                ordered = F.when(place(a) <= place(b), F.xxhash64(name(a), name(b), F.lit(0))).otherwise(F.xxhash64(name(b), name(a), F.lit(1)))
                return F.when(a.isNotNull() & b.isNotNull(), ordered).when(a.isNotNull(), F.xxhash64(name(a))).when(b.isNotNull(), F.xxhash64(name(b)))

            return F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), one)

        return _let(of, pairs)

    return _let(words, lambda w: _let(hashed(w), lambda p: _let(numbered(p), lambda s: _let(F.sort_array(s), lambda o: _let(least(o), sketch)))))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for equal fingerprints (two without members included)."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    same = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    any_ = F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    return F.when(any_ == 0, 1.0).otherwise(F.sqrt(same / F.greatest(any_, F.lit(1))))


def written(fingerprint: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits a sketch, `-` where there is none."""
    return F.array_join(F.transform(fingerprint, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 16, "0"), F.lit("-"))), "")


def next_in_order(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """keys (k, h, n), distinct in (k, h), with next_k, next_h: the next in descending order, the first after the last.

    Range partitions are numbered once; inside each a window looks ahead, and the step from one partition to the
    next comes from one row per partition.
    """
    parts = max(4, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = scratch.keep(keys.repartitionByRange(parts, F.desc("k"), F.desc("h")).withColumn("p", F.spark_partition_id()))
    heads = sorted((r["p"], r["t"]["k"], r["t"]["h"]) for r in ranged.groupBy("p").agg(F.max(F.struct("k", "h")).alias("t")).collect())
    after = [(p, *heads[(i + 1) % len(heads)][1:]) for i, (p, _, _) in enumerate(heads)]
    # one row per partition
    first = keys.sparkSession.createDataFrame(after, "p int, first_k long, first_h long")
    ahead = F.lead(F.struct("k", "h")).over(W.partitionBy("p").orderBy(F.desc("k"), F.desc("h")))
    out = ranged.withColumn("t", ahead).join(F.broadcast(first), "p")
    return out.select("k", "h", "n", F.coalesce("t.k", "first_k").alias("next_k"), F.coalesce("t.h", "first_h").alias("next_h"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text) with the fingerprints of the text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, by descending doc_id; the first follows the last. Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, next_doc_id. A null text counts as empty; a null doc_id comes last. Rows that share a
    doc_id follow one another by a hash of the text; rows that repeat both count once in that order and get equal results. A lone
    document is its own next. Extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("k"), F.xxhash64("text").alias("h"), "text")
    keys = base.groupBy("k", "h").agg(F.max(F.length("text")).cast("long").alias("n"))
    ring = scratch.keep(next_in_order(keys, scratch))
    printed = base.withColumn("f", fingerprint(F.col("text")))
    asked = ring.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 2).cast("int").alias("half"))
    given = printed.hint("merge").join(asked, ["k", "h"]).groupBy("to_k", "to_h").agg(F.first(F.struct(F.expr("left(text, half)").alias("head"), "f", "doc_id")).alias("next"))
    met = printed.hint("merge").join(given, (F.col("k") == F.col("to_k")) & (F.col("h") == F.col("to_h")))
    n = F.length("text")
    edited = met.select("doc_id", n.cast("long").alias("n_chars"), "f", F.col("next.f").alias("next_f"), F.col("next.doc_id").alias("next_doc_id"), F.concat(F.expr("left(text, length(text) - length(text) div 2)"), "next.head").alias("edited"))
    done = edited.withColumn("g", fingerprint(F.col("edited")))
    return done.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("f")).alias("fingerprint"), written(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"), likeness(F.col("f"), F.col("next_f")).alias("near_next"), "next_doc_id",
    )
