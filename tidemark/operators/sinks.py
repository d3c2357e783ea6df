"""Idempotent writes over Parquet tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stored(df: DataFrame, path: str) -> DataFrame | None:
    """The table at the path, or None."""
    try:
        return df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException:
        return None


def insert_absent(df: DataFrame, path: str, key: str) -> None:
    """Appends rows whose key is not stored; of repeated keys one row. An anti join on the key alone."""
    new = df.dropDuplicates([key])
    old = stored(df, path)
    if old is not None:
        new = new.join(old.select(key), key, "left_anti").select(df.columns)
    new.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key by ``at``; new rows win ties."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), F.desc("_side")))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_side")


def marked(checkpoints: DataFrame, results: DataFrame) -> DataFrame:
    """Checkpoints (item, status, attempts) after a batch's results (item, status): attempts count up."""
    joined = checkpoints.withColumnRenamed("status", "_old").join(results, "item", "full_outer")
    return joined.select("item", F.coalesce("status", "_old").alias("status"), (F.coalesce("attempts", F.lit(0)) + F.col("status").isNotNull().cast("int")).alias("attempts"))


def todo(items: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Items that are not done."""
    return items.join(checkpoints.where("status = 'done'").select("item"), "item", "left_anti")
