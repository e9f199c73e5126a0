"""Minimax contiguous partition of ordered atomic groups into shards.

Groups are equal texts, keyed and ordered by the sha-256 of the text; groups larger than
a shard's fair share come first. The smallest feasible capacity is found by binary search with a
greedy check; then shards are cut between the earliest and latest cuts of that capacity, each as near
to an even share of what is left as they allow, so that the largest shard is the smallest possible and no shard
stays empty needlessly.

For 100 TB: group sizes stay in a table. The driver sees sums over key prefixes (16^3 at first) and refines only
prefixes into which a cut may fall, one hexadecimal digit at a time, until they hold at most
`fine_rows` groups; then it reads those groups' sizes. Rows find their shard by comparing keys with the 23
cut keys, without a join, and their slot from a range partitioning by shard, key, doc_id and row, so
that no group, however large, or doc_id is one task's: the driver sums rows by range and
shard, a window numbers them inside a range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .textops import Scratch

SHARDS, EXTRA = 24, 8
#: Groups that the driver may hold while it places the cuts.
FINE_ROWS = 200_000


def greedy(prefix: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Latest cut positions (number of groups before each cut) with no shard above capacity, or None. prefix[i]: size of the first i groups."""
    cuts, at, n = [], 0, len(prefix) - 1
    for _ in range(shards):
        at = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        cuts.append(at)
    return cuts if at >= n else None


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """(smallest feasible capacity, inner cut positions) over contiguous groups in order."""
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    total, n = int(prefix[-1]), len(sizes)
    lo, hi = max(int(sizes.max(initial=0)), -(-total // shards)), total
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(prefix, mid, shards):
            hi = mid
        else:
            lo = mid + 1
    latest = greedy(prefix, lo, shards)
    # earliest cuts: the greedy check from the right end
    back = total - prefix[::-1]
    earliest = [n - c for c in reversed(greedy(back, lo, shards)[:-1])]
    cuts, at = [], 0
    for k in range(shards - 1):
        want = prefix[at] + (total - prefix[at]) / (shards - k)
        i = int(np.searchsorted(prefix, want))
        if i > 0 and want - prefix[i - 1] <= prefix[min(i, n)] - want:
            i -= 1
        reach = int(np.searchsorted(prefix, prefix[at] + lo, "right")) - 1
        at = max(earliest[k], at, min(i, latest[k], reach))
        cuts.append(at)
    return lo, cuts


def shard_documents(docs: DataFrame, shards: int = SHARDS, fine_rows: int = FINE_ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8. Law `bytes`: sizes of shards are as equal as whole groups
    of equal texts allow. A null text has size 8, no crc, and groups with other nulls; an empty text is a group apart. slot
    numbers a shard's rows without gaps from 0, groups together, then by doc_id, null first; repeated rows get slots of their own. With fewer
    groups than shards some stay empty. Extra columns are ignored; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    raw = F.col("text").cast("binary")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.sha2(raw, 256), F.lit("")).alias("sha"), F.monotonically_increasing_id().alias("tie"))
    keyed = scratch.keep(keyed)
    groups = scratch.keep(keyed.groupBy("sha").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = sorted((r["sha"], r["size"]) for r in groups.where(F.col("size") * shards > total).select("sha", "size").collect())  # fewer than `shards`
    names = [h for h, _ in heavy]
    light = groups.where(~F.col("sha").isin(names)) if names else groups

    # segments of the light groups in key order: (key prefix, size, groups); refined where a cut may fall
    segments = {p: (s, n) for p, s, n in _sums(light, 3)}
    depth = 3
    while True:
        order = sorted(segments)
        sizes = np.array([s for _, s in heavy] + [segments[p][0] for p in order], np.int64)
        near = _uncertain(sizes, shards, len(heavy))
        wide = [order[i] for i in near if len(order[i]) == depth]
        if not wide or sum(segments[p][1] for p in wide) <= fine_rows:
            break
        depth += 1
        for p in wide:
            del segments[p]
        segments |= {p: (s, n) for p, s, n in _sums(light.where(F.substring("sha", 1, depth - 1).isin(wide)), depth)}
    for p in wide:
        del segments[p]
    if wide:
        found = light.where(F.substring("sha", 1, depth).isin(wide)).select("sha", "size").collect()
        segments |= {r["sha"]: (r["size"], 1) for r in found}
    order = sorted(segments)
    sizes = np.array([s for _, s in heavy] + [segments[p][0] for p in order], np.int64)
    _, cuts = minimax_cuts(sizes, shards)
    keys = [f"0{h}" for h in names] + [f"1{p}" for p in order] + ["2"]
    bounds = [keys[min(c, len(keys) - 1)] for c in cuts]
    rank = F.concat(F.when(F.col("sha").isin(names), "0").otherwise("1") if names else F.lit("1"), F.col("sha"))
    shard = sum((F.when(rank >= b, 1).otherwise(0) for b in bounds), F.lit(0))

    order = ["shard", "rank", "doc_id", "tie"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = keyed.withColumn("rank", rank).withColumn("shard", shard.cast("int")).drop("sha")
    placed = scratch.keep(placed.repartitionByRange(parts, *order).withColumn("span", F.spark_partition_id()))
    counts = placed.groupBy("shard", "span").agg(F.count("*").alias("n")).collect()  # at most a row a range and a row a cut
    begin, at, last = [], 0, None
    for r in sorted(counts, key=lambda r: (r["shard"], r["span"])):
        at = 0 if r["shard"] != last else at
        begin.append((r["shard"], r["span"], at))
        at, last = at + r["n"], r["shard"]
    offsets = spark.createDataFrame(begin, "shard int, span int, begin long")
    inside = F.row_number().over(W.partitionBy("shard", "span").orderBy(*order[1:])) - 1
    out = placed.withColumn("inside", inside).join(F.broadcast(offsets), ["shard", "span"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _sums(groups: DataFrame, depth: int) -> list[tuple[str, int, int]]:
    stem = F.substring("sha", 1, depth).alias("p")
    return [(r["p"], r["s"], r["n"]) for r in groups.groupBy(stem).agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()]


def _uncertain(sizes: np.ndarray, shards: int, heavy: int) -> list[int]:
    """Segments (after the heavy ones) into which a cut may fall while sizes within a segment are unknown.

    The capacity lies between the fluid bound and the one for whole segments, so cut k lies within the spread of
    k capacities around any cut of whole segments.
    """
    prefix = np.concatenate(([0], np.cumsum(sizes)))
    total = int(prefix[-1])
    if not len(sizes) or not total:
        return []
    high, _ = minimax_cuts(sizes, shards)
    low = max(-(-total // shards), int(sizes[:heavy].max(initial=0)))
    slack = high - low + int(sizes[heavy:].max(initial=0))
    marked = np.zeros(len(sizes), bool)
    _, cuts = minimax_cuts(sizes, shards)
    for k, c in enumerate(cuts, 1):
        room = slack * min(k, shards - k)
        lo, hi = np.searchsorted(prefix, [prefix[c] - room, prefix[c] + room])
        marked[max(0, lo - 1) : hi + 1] = True
    return [i - heavy for i in np.flatnonzero(marked) if i >= heavy]
