"""Forward folds of an entity's history, as windows: no row sees what comes after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(rows: DataFrame, key: str, order: list[str], steps: Column, state: Column, conversion: Column, formation: Column, day: str) -> DataFrame:
    """``rows`` with prev_amount, in_force, converted, founded.

    The state before a row comes from earlier rows alone; the founding day counts the row itself.
    """
    w = Window.partitionBy(key).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        F.last(steps, ignorenulls=True).over(before).alias("prev_amount"),
        F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)).alias("in_force"),
        F.coalesce(F.max(conversion.cast("int")).over(before) == 1, F.lit(False)).alias("converted"),
        F.first(F.when(formation, F.col(day)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("founded"),
    )


def trailing_run(rows: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """The last unbroken run of the value that a key ends with: gaps and islands from the end."""
    back = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    told = rows.withColumn("_last", F.first(value).over(back))
    broken = F.sum((F.col(value) != F.col("_last")).cast("int")).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return told.withColumn("_broken", broken).where("_broken = 0").drop("_last", "_broken")
