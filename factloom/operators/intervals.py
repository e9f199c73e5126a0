"""Overlapping intervals and token spans, by windows within a group."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_groups(rows: DataFrame, keys: Sequence[str], start: str, end: str, order: Sequence[str] = (), alone: bool = False) -> DataFrame:
    """Intervals that overlap another of their key, with the number of their group (from 1); closed ends touch.

    An interval opens a group if it starts after all that came before have ended. Groups of one are left out unless `alone`.
    """
    w = W.partitionBy(*keys).orderBy(start, end, *order)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (before < F.col(start)), 1).otherwise(0)
    island = rows.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w.rowsBetween(W.unboundedPreceding, 0)))
    sized = island.withColumn("_size", F.count("*").over(W.partitionBy(*keys, "_island")))
    sized = sized if alone else sized.where("_size > 1")
    return sized.withColumn("group_no", F.dense_rank().over(W.partitionBy(*keys).orderBy("_island"))).drop("_opens", "_island", "_size")


def longest_per_group(groups: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The longest interval of each group, the first among equals."""
    length = F.datediff(end, start) if dict(groups.dtypes)[start] in ("date", "timestamp", "timestamp_ntz") else F.col(end) - F.col(start)
    rank = F.row_number().over(W.partitionBy(*keys, "group_no").orderBy(F.desc(length), start, end))
    return groups.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def longest_first(starts: Sequence[int], ends: Sequence[int]) -> list[int]:
    """Indexes of the spans kept, in text order: by length, then start, each unless it overlaps one kept before. Ends are exclusive.

    What is kept before a span is at least as long, so it overlaps the span only if it covers the span's first or last place. A place is covered once at
    most, so after the sort the work is linear in the spans.
    """
    order = sorted((i for i in range(len(starts)) if ends[i] > starts[i]), key=lambda i: (starts[i] - ends[i], starts[i]))
    places = sorted({p for i in order for p in (starts[i], ends[i] - 1)})
    number = {p: k for k, p in enumerate(places)}
    covered, kept = bytearray(len(places)), []
    for i in order:
        a, b = number[starts[i]], number[ends[i] - 1]
        if not (covered[a] or covered[b]):
            covered[a : b + 1] = b"\x01" * (b + 1 - a)
            kept.append(i)
    return sorted(kept, key=starts.__getitem__)


def keep_longest(spans: Column) -> Column:
    """array<struct<start, end>>: spans without overlap, greedily by length, then start; ends are exclusive. Result in text order, with long ends.

    Null and empty arrays give empty ones; spans without length and null spans are left out. Arrow batches pass through longest_first: n log n in the spans of a row.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(given: pa.Array) -> pa.Array:
        out = []
        for row in given:
            found = [(x["start"], x["end"]) for x in row.as_py() or () if x is not None and x["start"] is not None and x["end"] is not None]
            starts, ends = [a for a, _ in found], [b for _, b in found]
            out.append([{"start": starts[i], "end": ends[i]} for i in longest_first(starts, ends)])
        return pa.array(out, kind)

    return F.arrow_udf(run, "array<struct<start: long, end: long>>")(F.transform(spans, lambda s: F.struct(s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))))


def runs_of_equal(tokens: DataFrame, keys: Sequence[str], position: str, label: str, width: int = 1 << 16) -> DataFrame:
    """Spans of consecutive positions (whole numbers, each once a key) with one label: keys, label, first, last.

    Positions are binned by `width`: runs inside a bin are found there, and only those that touch a bin's edge are put together over the bins, so
    however common a label is, a window holds `width` rows of it, or one or two for each bin. Without keys the label alone parts the rows.
    """
    by = [*keys, label]
    bin_ = F.floor(F.col(position) / width)
    w = W.partitionBy(*by, "_bin").orderBy(position)
    rows = tokens.where(F.col(label).isNotNull()).withColumn("_bin", bin_).withColumn("_island", F.col(position) - F.row_number().over(w))
    runs = rows.groupBy(*by, "_bin", "_island").agg(F.min(position).alias("first"), F.max(position).alias("last"))
    edge = (F.col("first") == F.col("_bin") * width) | (F.col("last") == (F.col("_bin") + 1) * width - 1)
    order = W.partitionBy(*by).orderBy("first")
    open_ = runs.where(edge).withColumn("_opens", F.when(F.lag("last").over(order) == F.col("first") - 1, 0).otherwise(1))
    open_ = open_.withColumn("_island", F.sum("_opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = open_.groupBy(*by, "_island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.where(~edge).select(*by, "first", "last").unionByName(whole.select(*by, "first", "last"))


def pairs_within(rows: DataFrame, group: str, position: str, label: str, distance: int | None = None) -> DataFrame:
    """Ordered pairs of different entities of a group, at most `distance` apart.

    With a distance, both sides are binned by it, so a group's rows meet only those of the same and the neighbouring bins.
    """
    width = distance or 1
    a = rows.select(group, F.col(position).alias("a_pos"), F.col(label).alias("a_label"))
    b = rows.select(group, F.col(position).alias("b_pos"), F.col(label).alias("b_label"))
    if distance is None:
        return a.join(b, group).where("a_pos <> b_pos")
    a = a.withColumn("_bin", F.floor(F.col("a_pos") / width))
    b = b.withColumn("_bin", F.explode(F.array(*[F.floor(F.col("b_pos") / width) + d for d in (-1, 0, 1)])))
    return a.join(b, [group, "_bin"]).where((F.col("a_pos") != F.col("b_pos")) & (F.abs(F.col("a_pos") - F.col("b_pos")) <= distance)).drop("_bin")


def tokens_in_both(entities: DataFrame, group: str, label: str, first: str, second: str) -> DataFrame:
    """Groups that hold entities of both labels."""
    found = entities.groupBy(group).agg(F.bool_or(F.col(label) == first).alias("a"), F.bool_or(F.col(label) == second).alias("b"))
    return found.where("a and b").select(group)
