"""As-of views: what was visible on a day, and what cancels, corrects or renames it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(df: DataFrame, as_of: str, day: str = "published_at") -> DataFrame:
    """Rows published on or before the day. Every dated reader goes through this one predicate."""
    return df.where(F.col(day) <= F.lit(as_of).cast("date"))


def uncancelled(rows: DataFrame, cancellations: DataFrame, number: str) -> DataFrame:
    """Rows whose number no visible cancellation names; an anti join on the number."""
    named = cancellations.where(F.col("cancels").isNotNull()).select(F.col("cancels").alias(number))
    return rows.join(named, number, "left_anti")


def latest(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """(key, latest): the value of each key's last row in the order given; one partial aggregate and exchange."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("latest"))


def as_of_join(facts: DataFrame, history: DataFrame, key: str, fact_day: str, history_day: str, value: str, tie: str) -> DataFrame:
    """``facts`` with ``value`` of the latest history row of the key on or before the fact's day.

    Both sides are stacked and carried forward in one window, so the join does not multiply rows.
    """
    columns = facts.columns
    a = facts.withColumn("_day", F.col(fact_day)).withColumn("_side", F.lit(1)).withColumn("_tie", F.lit(None).cast(history.schema[tie].dataType)).withColumn("_value", F.lit(None).cast(history.schema[value].dataType))
    b = history.where(F.col(value).isNotNull()).select(F.col(key), F.col(history_day).alias("_day"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_value"))
    run = Window.partitionBy(key).orderBy("_day", "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_value", F.last("_value", ignorenulls=True).over(run))
    return both.where("_side = 1").select(*columns, F.col("_value").alias(value))


def carried(value: Column, key: str, *order: str) -> Column:
    """The last non-null value before the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def interval_match(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, before: int, after: int) -> DataFrame:
    """Pairs with equal keys whose right day lies from ``before`` days before to ``after`` days after the left day."""
    return left.join(right, key).where(F.col(right_day).between(F.date_sub(left_day, before), F.date_add(left_day, after)))
