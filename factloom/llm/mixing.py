"""Mixing sources to target weights over fixed-length blocks.

Each source's words, documents in a fixed pseudorandom order, form one stream cut into
blocks of BLOCK words. Targets are filled by weight and capped. Output shards draw
multinomial source counts (the last draws fit what is left, so every source's total is exact), a
shard's slots number on within each source, and a slot's number goes through the source's
index permutation (a fresh one for each pass over the stream) to the block it takes. Blocks
join by (source, index). A source's last slot stops at the words that the source still owes, so it gives its target to the word, however small it is.

For 100 TB: documents get their place in the stream from bucket sums and a window inside a bucket, so
no source, even one with a third of all rows, is ordered in one task; rows that repeat are counted first. Slots come from a range
split over tasks, and the join is on unique block indexes. The driver sees one row per source; bucket sums stay a table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import Scratch

BLOCK, SHARDS, SHARE, CAP, SEED = 32, 64, 1.5, 2, 20240801
#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
ROUNDS = 4
#: Multipliers of the index permutation: primes about 10^6 to 10^7, so products stay far below 2^63.
PRIMES = (1000003, 1299709, 2750159, 4256233, 5800079, 7368787, 8960453)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def fill_targets(sizes: list[int], weights: list[int], share: float, cap: float) -> list[float]:
    """Shares of `share` times all sizes by weight; what exceeds cap times a size is shared again among the rest."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def draw(totals: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) slot counts: each shard draws from the sources in proportion to what they still owe."""
    rng, left = np.random.default_rng(seed), np.array(totals, np.int64)
    out = np.zeros((shards, len(totals)), np.int64)
    for k in range(shards - 1):
        room = int(left.sum()) // (shards - k)
        while room > 0:
            got = np.minimum(rng.multinomial(room, left / left.sum()), left)
            out[k] += got
            left -= got
            room -= int(got.sum())
    out[-1] = left
    return out


def permuted(slots: DataFrame, seed: int) -> DataFrame:
    """Adds `index`, a pseudorandom permutation of `at` in 0 .. size-1 for each source s and pass epoch.

    Each round maps x to (a x + c) mod size, a coprime to size, then swaps x and x + half by keyed
    bits. Rounds are columns of their own: nested, the expression would grow by its own size each round.
    """
    out, size = slots.withColumn("index", F.col("at")), F.col("size")
    half, x = F.floor(size / 2), F.col("index")
    for r in range(ROUNDS):
        # a is the first prime of the list that does not divide size
        order = PRIMES[r:] + PRIMES[:r]
        a = F.coalesce(*[F.when(size % p != 0, F.lit(p).cast("long")) for p in order], F.lit(1).cast("long"))
        out = out.withColumn("key", F.xxhash64("s", "epoch", F.lit(seed + r)))
        out = out.withColumn("index", F.pmod(x * F.pmod(a, size) + F.pmod("key", size), size))
        out = out.withColumn("pair", F.when(x < half, x).otherwise(x - half))
        flip = (x < 2 * half) & (F.xxhash64("pair", "key") % 2 == 0)
        out = out.withColumn("index", F.when(flip, F.when(x < half, x + half).otherwise(F.col("pair"))).otherwise(x))
    # never null: else the join's null filter is pushed through the rounds and the plan grows past any memory
    return out.withColumn("index", F.coalesce("index", F.lit(-1).cast("long"))).drop("key", "pair")


class Mix:
    """The laid-out streams and what the output takes from them."""

    def __init__(self, docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, share: float = SHARE, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED):
        self.spark: SparkSession = docs.sparkSession
        self.block, self.seed = block, seed
        keep = Scratch(self.spark, "mixing").keep
        parts = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        source = F.col("source").cast("string")
        sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))
        # rows that repeat are counted before they move
        sized = sized.groupBy("source", "doc_id", "content", "size").agg(F.count("*").alias("copies"))
        # a null source joins as its own key
        sized = sized.select(F.coalesce("source", F.lit("")).alias("named"), F.col("source").isNull().alias("none"), F.pmod(F.xxhash64("doc_id", "content", F.lit(seed)), F.lit(parts)).cast("int").alias("bucket"), "*")
        own = ("named", "none", "bucket")
        sums = keep(sized.groupBy(*own).agg(F.sum(F.col("size") * F.col("copies")).alias("n")))
        # one row a source; code-point order: Python compares strings by code point
        totals = sorted(((r["none"], r["named"]), r["n"]) for r in sums.groupBy("none", "named").agg(F.sum("n").alias("n")).collect())
        self.sizes = [n for _, n in totals]
        self.targets = fill_targets(self.sizes, [weights[i % len(weights)] for i in range(len(totals))], share, cap)
        self.fill = [self._slots(n, min(round(t), cap * n)) for n, t in zip(self.sizes, self.targets, strict=True)]
        self.draws = draw([m for m, _ in self.fill], shards, seed) if totals else np.zeros((shards, 0), np.int64)
        self.plan = self.spark.createDataFrame([(name, none, i, self.sizes[i], self.targets[i]) for i, ((none, name), _) in enumerate(totals)], "named string, none boolean, s int, source_size long, target double")
        before = F.coalesce(F.sum("n").over(W.partitionBy("named", "none").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        begins = keep(sums.withColumn("base", before).drop("n").join(self.plan, ["named", "none"]))
        order = W.partitionBy(*own).orderBy("doc_id", "content").rowsBetween(W.unboundedPreceding, -1)
        laid = sized.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0))).join(begins, [*own])
        laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
        self.laid = laid.select("doc_id", "source", "content", "copy", "size", "s", "source_size", "target", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("begin"))

    def _slots(self, size: int, words: int) -> tuple[int, int]:
        """(slots, words that the last one takes) for a source of `size` words to give `words`.

        A pass over the source takes its whole blocks, permuted, then its short last block, so the words of any number of slots are known, and
        the last slot stops at the words still owed.
        """
        if not words:
            return 0, 0
        passes, rest = divmod(words - 1, size)
        full, rest = divmod(rest, self.block)
        return passes * -(-size // self.block) + full + 1, rest + 1

    def names(self) -> DataFrame:
        """(s, source), one row a source."""
        return self.plan.select("s", F.when(~F.col("none"), F.col("named")).alias("source"))

    def slots(self) -> DataFrame:
        """(shard, slot, s, index, upto): the block each slot of the output takes, and its first words that it takes."""
        ends = np.cumsum(self.draws, 0)
        rows = [(k, s, int(ends[k, s] - n), int(n), self.sizes[s], *self.fill[s]) for k, shard in enumerate(self.draws.tolist()) for s, n in enumerate(shard) if n]
        schema = "shard int, s int, first long, n long, words long, slots long, last long"
        runs = self.spark.createDataFrame(rows, schema)
        # runs of 4096 slots first, dealt to all tasks, then single slots
        split = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).alias("lo"))
        split = split.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "shard", "s", "lo")
        one = split.select("*", F.explode(F.sequence("lo", F.least(F.col("lo") + 4095, F.col("n") - 1))).alias("slot"))
        number, blocks, whole = F.col("first") + F.col("slot"), F.ceil(F.col("words") / self.block), F.floor(F.col("words") / self.block)
        upto = F.when(number == F.col("slots") - 1, F.col("last")).otherwise(F.lit(self.block).cast("long"))
        one = one.select("shard", "slot", "s", (number % blocks).alias("at"), F.greatest(whole, F.lit(1)).alias("size"), whole.alias("whole"), F.floor(number / blocks).alias("epoch"), upto.alias("upto"))
        # the short last block is its own place
        return permuted(one, self.seed).select("shard", "slot", "s", F.when(F.col("at") < F.col("whole"), F.col("index")).otherwise(F.col("at")).alias("index"), "upto")

    def uses(self) -> DataFrame:
        """(s, index, uses, part, more): how often each block is taken whole, the words at its start taken `more` times on top."""
        cut = F.col("upto") < self.block
        found = self.slots().groupBy("s", "index").agg(F.count_if(~cut).cast("int").alias("uses"), F.max(F.when(cut, F.col("upto")).otherwise(0)).alias("part"))
        return found.withColumn("more", F.when(F.col("part") > 0, 1).otherwise(0))

    def pieces(self) -> DataFrame:
        """(s, doc_id, content, copy, index, from_word, words, uses) for each row and block it reaches into, cut where a block is left; copy numbers rows that repeat source, doc_id and text."""
        b = self.block
        reach = self.laid.where("size > 0").withColumn("index", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))))
        # written first: joined in place, the permutation's rounds take the optimizer hundreds of MB
        met = reach.join(Scratch(self.spark, "mixing").keep(self.uses()), ["s", "index"])
        lo, hi, cut = F.greatest("begin", F.col("index") * b), F.least(F.col("begin") + F.col("size"), (F.col("index") + 1) * b), F.col("index") * b + F.col("part")
        part = lambda a, z, uses: F.struct((a - F.col("begin")).alias("from_word"), (z - a).alias("words"), uses.alias("uses"))
        two = F.array(part(lo, F.least(hi, cut), F.col("uses") + F.col("more")), part(F.greatest(lo, cut), hi, F.col("uses")))
        return met.select("doc_id", "content", "copy", "s", "index", F.explode(two).alias("of")).select("doc_id", "content", "copy", "s", "index", "of.*").where("words > 0 and uses > 0")


_ROW = ("s", "doc_id", "content", "copy")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs (doc_id, source, text): doc_id, size, source_size, target, taken.

    taken counts the words the mix takes, repeats included: at most twice size. Null and empty texts
    have size 0 and give nothing. Rows that repeat source, doc_id and text are numbered and each
    stands in the stream for itself. A null source is a source of its own, last in order; extra columns are
    ignored; an empty table gives no rows.
    """
    mix = Mix(docs, **options)
    t = mix.pieces().groupBy(*[F.col(c).alias(f"t_{c}") for c in _ROW]).agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in _ROW]
    out = mix.laid.join(t, [*same], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, **options) -> DataFrame:
    """docs as mixed: for each pass p over a row, a row with the words of its blocks taken at least p times.

    Blocks join by index and a row's words by one space; other columns keep their values, n_chars is that of the
    new text. A row of which nothing is taken gives none, among them null, empty and blank texts. Rows that repeat source, doc_id
    and text each give their own words, numbered by their other plain columns. Columns: those of docs.
    """
    mix = Mix(docs, **options)
    pieces = mix.pieces().join(mix.names(), "s").groupBy("doc_id", "content", "copy", "source").agg(F.collect_list(F.struct("from_word", "words", "uses")).alias("__mix_taken"))
    t = pieces.select(F.col("doc_id").alias("__mix_id"), F.col("content").alias("__mix_content"), F.col("copy").alias("__mix_number"), F.col("source").alias("__mix_of"), "__mix_taken")
    given, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    plain = [f.name for f in docs.schema if f.name not in ("doc_id", "text", "source") and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    keyed = docs.withColumn("__mix_key", F.xxhash64("text"))
    one = W.partitionBy(given, source, "__mix_key").orderBy(*[F.col(f"`{c}`") for c in plain] or [F.lit(0)])
    keyed = keyed.withColumn("__mix_copy", F.row_number().over(one) - 1)
    met = keyed.join(t.hint("merge"), given.eqNullSafe(F.col("__mix_id")) & source.eqNullSafe(F.col("__mix_of")) & (F.col("__mix_key") == F.col("__mix_content")) & (F.col("__mix_copy") == F.col("__mix_number")))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    most = F.array_max(F.transform("__mix_taken", lambda x: x["uses"]))
    passes = met.withColumn("__mix_words", words).withColumn("__mix_pass", F.explode(F.sequence(F.lit(1), most)))
    chosen = F.array_sort(F.filter("__mix_taken", lambda x: x["uses"] >= F.col("__mix_pass")))
    text = F.array_join(F.flatten(F.transform(chosen, lambda x: F.slice("__mix_words", (x["from_word"] + 1).cast("int"), x["words"].cast("int")))), " ")
    made = passes.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])
