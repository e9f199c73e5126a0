"""Fact selection and deduplication: nested fact JSON to one value per entity and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tags of each metric.
SHARE_TAGS = ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding")
CASH_TAGS = ("Cash", "CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "RestrictedCashAndCashEquivalentsAtCarryingValue")
FLOW_TAGS = {kind: (f"(?i)netcash(.*){stem}(.*)", f"NetCashProvidedByUsedIn{kind.title()}Activities") for kind, stem in (("operating", "operat"), ("investing", "invest"), ("financing", "financ"))}
FACTS_SCHEMA = "facts map<string, map<string, struct<units: map<string, array<struct<start: date, `end`: date, val: double, fy: int>>>>>>"


def explode_facts(raw: DataFrame, entity: str, json: str) -> DataFrame:
    """One row per fact of a column of companyfacts JSON: entity, taxonomy, tag, unit, start, end, val, fy. Malformed JSON gives none."""
    parsed = raw.select(entity, F.from_json(json, FACTS_SCHEMA).alias("j"))
    tags = parsed.select(entity, F.explode("j.facts").alias("taxonomy", "tags")).select(entity, "taxonomy", F.explode("tags").alias("tag", "body"))
    return tags.select(entity, "taxonomy", "tag", F.explode("body.units").alias("unit", "rows")).select(entity, "taxonomy", "tag", "unit", F.inline("rows"))


def select_facts(facts: DataFrame, name: str | Sequence[str], tag: str = "tag", taxonomy: tuple[str, str] | None = None) -> DataFrame:
    """Facts whose tag is one of the names (exact), or is matched by a pattern; optionally of one taxonomy (column, value)."""
    wanted = F.col(tag).rlike(name) if isinstance(name, str) else F.col(tag).isin(*name)
    return facts.where(wanted if taxonomy is None else wanted & (F.col(taxonomy[0]) == taxonomy[1]))


def dedup_largest(facts: DataFrame, keys: Sequence[str], value: str, *carry: str) -> DataFrame:
    """One row per key with the largest value; NaN counts as missing. Carried columns come from that row, the largest carried first among ties."""
    clean = facts.withColumn(value, F.nanvl(F.col(value), F.lit(None).cast("double")))
    pick = F.struct(value, *carry)
    best = clean.groupBy(*keys).agg(F.max(pick).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in (value, *carry)])


def dedup_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the order: newest wins with descending order, first wins with arrival order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def outer_by_tag(facts: DataFrame, keys: Sequence[str], tag: str, tags: Sequence[str], value: str) -> DataFrame:
    """The full outer join of the tags on the keys - a column per tag, its largest value - as one pivot, hence one shuffle."""
    clean = F.nanvl(F.col(value), F.lit(None).cast("double"))
    wide = [F.max(F.when(F.col(tag) == t, clean)).alias(t) for t in tags]
    return facts.where(F.col(tag).isin(*tags)).groupBy(*keys).agg(*wide)


def largest_of(wide: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Adds the row's largest non-missing value."""
    return wide.withColumn(name, F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))


def union_distinct(*frames: DataFrame) -> DataFrame:
    """Distinct rows of all frames: the full outer join on all columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.distinct()


def outstanding_shares(facts: DataFrame, entity: str) -> DataFrame:
    """entity, end, val, tag: both share tags of either taxonomy, the largest value per tag and end."""
    wanted = select_facts(facts, SHARE_TAGS).where(F.col("taxonomy").isin("us-gaap", "dei"))
    return dedup_largest(wanted, [entity, "tag", "end"], "val").select(entity, "end", "val", "tag").distinct()


def net_cash(facts: DataFrame, entity: str) -> DataFrame:
    """entity, end, val: the largest of the cash tags per end."""
    wanted = select_facts(facts, CASH_TAGS, taxonomy=("taxonomy", "us-gaap"))
    return largest_of(outer_by_tag(wanted, [entity, "end"], "tag", CASH_TAGS, "val"), CASH_TAGS, "val").select(entity, "end", "val")


def cash_flow(facts: DataFrame, entity: str, kind: str) -> DataFrame:
    """entity, start, end, val of a flow. Operating and investing flows keep the newest fiscal year, financing the first row in file order."""
    gate, exact = FLOW_TAGS[kind]
    wanted = select_facts(facts, gate, taxonomy=("taxonomy", "us-gaap")).where(F.col("tag") == exact)
    order = [F.col("fy").asc_nulls_last(), "val"] if kind == "financing" else [F.col("fy").desc_nulls_last(), F.desc("val")]
    return dedup_by(wanted, [entity, "start", "end"], order).select(entity, "start", "end", "val")


def cash_flows(facts: DataFrame, entity: str) -> DataFrame:
    """entity, kind, start, end, val: cash_flow of every kind in one pass over the facts."""
    exact = {tag: kind for kind, (_, tag) in FLOW_TAGS.items()}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in exact.items() for x in kv]), F.col("tag"))
    wanted = select_facts(facts, tuple(exact), taxonomy=("taxonomy", "us-gaap")).withColumn("kind", kind)
    # rows of one group are of one kind: the other kinds' columns are null in all of them
    first, newest = (lambda c: F.when(F.col("kind") == "financing", F.col(c))), (lambda c: F.when(F.col("kind") != "financing", F.col(c)))
    order = [first("fy").asc_nulls_last(), first("val"), newest("fy").desc_nulls_last(), newest("val").desc()]
    return dedup_by(wanted, [entity, "kind", "start", "end"], order).select(entity, "kind", "start", "end", "val")


def review_cash(facts: DataFrame, entity: str) -> DataFrame:
    """The wide review table: a column per cash tag over both taxonomies, by end."""
    return outer_by_tag(facts.where(F.col("taxonomy").isin("us-gaap", "dei")), [entity, "end"], "tag", CASH_TAGS, "val").orderBy(entity, "end")
