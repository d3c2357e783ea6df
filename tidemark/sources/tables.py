"""Typed scans of the driver's tables in the roles the engine gives them.

``events`` plays the gazette: a user is an entity, the day of ``ts`` the publication day, ``event_id`` the
publication number. signup is a formation, purchase a capital step, view a name row, click other, error a
cancellation of the event ``k + 1`` numbers before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, published_at, type, amount, k)."""
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("published_at"), F.col("event_type").alias("type"),
        F.col("value").cast("decimal(18,2)").alias("amount"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date")).drop("o_orderdate")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("day", F.col("l_shipdate").cast("date")).drop("l_shipdate")
