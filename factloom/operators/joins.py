"""Joins of a company's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """parents with one array column of child structs per relation, each gathered by one aggregation on its foreign key; sorted, empty if none."""
    out = parents
    for name, (child, foreign) in children.items():
        fields = F.struct(*[c for c in child.columns if c != foreign])
        grouped = child.groupBy(F.col(foreign).alias(key)).agg(F.sort_array(F.collect_list(fields)).alias(name))
        out = out.join(grouped, key, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))
    return out


def with_reference(rows: DataFrame, key: str, foreign: str, columns: list[str], prefix: str) -> DataFrame:
    """Self-join: the named columns of the row that `foreign` points to."""
    other = rows.select(F.col(key).alias("_k"), *[F.col(c).alias(prefix + c) for c in columns])
    return rows.join(other, F.col(foreign) == F.col("_k"), "left").drop("_k")


def join_either(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """left joined to right rows that name its key in either column, each pair once: two equi-joins, no nested loop, no distinct. Repeated rows stay."""
    a = left.join(right, F.col(key) == F.col(first))
    b = left.join(right, F.col(key) == F.col(second)).where(~F.col(key).eqNullSafe(F.col(first)))
    return a.unionByName(b)


def through_bridge(left: DataFrame, bridge: DataFrame, right: DataFrame, left_on: Column, right_on: Column) -> DataFrame:
    return left.join(bridge, left_on).join(right, right_on)


def counted(facts: DataFrame, dimension: DataFrame, on: Column, name: str) -> DataFrame:
    """Rows per dimension name."""
    return facts.join(dimension, on).groupBy(name).agg(F.count("*").alias("n"))
