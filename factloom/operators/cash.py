"""Burn rates and cash runway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .facts import dedup_by

FLOWS = ("operating", "financing", "investing")


def daily_rate(amount: Column, start: Column, end: Column) -> Column:
    """amount per day; a period of no days has no rate."""
    days = F.datediff(end, start)
    return F.when(days != 0, amount / days)


def burn_rates(flows: DataFrame, entity: str, kind: str = "kind") -> DataFrame:
    """entity, from_date, to_date, burn_rate_<flow>, burn_rate_total from flows (entity, kind, from_date, to_date, amount).

    The outer join of the three flows on entity and period is one aggregation. The total is operating plus investing,
    a missing one counting 0. Of periods with one start only the longest stay.
    """
    rate = daily_rate(F.col("amount"), F.col("from_date"), F.col("to_date"))
    wide = flows.groupBy(entity, "from_date", "to_date").agg(*[F.max(F.when(F.col(kind) == k, rate)).alias(f"burn_rate_{k}") for k in FLOWS])
    total = wide.withColumn("burn_rate_total", F.coalesce("burn_rate_operating", F.lit(0.0)) + F.coalesce("burn_rate_investing", F.lit(0.0)))
    return longest_per_start(total, [entity, "from_date"], "to_date")


def longest_per_start(rows: DataFrame, keys: list[str], end: str) -> DataFrame:
    """Rows whose end is the largest of their key; ties all stay."""
    return rows.withColumn("_last", F.max(end).over(W.partitionBy(*keys))).where(F.col(end) == F.col("_last")).drop("_last")


def latest(rows: DataFrame, entity: str, by: str, *ties: Column) -> DataFrame:
    """The row with the largest `by` of each entity, null first as in a descending sort of the store."""
    return dedup_by(rows, [entity], [F.col(by).desc_nulls_first(), *ties])


def runway(net_cash: DataFrame, burn: DataFrame, entity: str, as_of: str) -> DataFrame:
    """entity, burn_rate, burn_rate_date, net_cash, net_cash_date, days_of_cash, days_of_cash_date as of a date.

    The latest net cash is carried forward at the latest burn rate to as_of, its absolute value divided by the absolute
    rate and rounded to 2 places. A rate of 0 or above never uses cash up: days_of_cash is infinity.
    """
    cash = latest(net_cash, entity, "instant", F.desc("amount")).select(entity, F.col("amount").alias("net_cash"), F.col("instant").alias("net_cash_date"))
    rate = latest(burn, entity, "to_date", F.desc("from_date")).select(entity, F.col("burn_rate_total").alias("burn_rate"), F.col("to_date").alias("burn_rate_date"))
    both = cash.join(rate, entity)
    left = F.col("net_cash") + F.col("burn_rate") * F.datediff(F.lit(as_of).cast("date"), "net_cash_date")
    days = F.when(F.col("burn_rate") >= 0, F.lit(float("inf"))).otherwise(F.round(F.abs(left) / F.abs("burn_rate"), 2))
    return both.select(entity, "burn_rate", "burn_rate_date", "net_cash", "net_cash_date", days.alias("days_of_cash"), F.lit(as_of).cast("date").alias("days_of_cash_date"))
