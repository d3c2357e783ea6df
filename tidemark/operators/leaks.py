"""Whether dated outputs read nothing that came later, and draws of the keys that are looked at.

An output as of a day must be the same over all facts and over the facts up to that day alone. That needs no list of what
may leak: whatever a later fact changes, a row, a count or an order, is a difference. A control that does read later facts must
be caught, else the check shows nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import releases


def differing(one: DataFrame, other: DataFrame) -> int:
    """Rows that one has more often than the other, either way."""
    other = other.select(*one.columns)
    return one.exceptAll(other).unionAll(other.exceptAll(one)).count()


def leaking(outputs: dict[str, Callable[[DataFrame, str], DataFrame]], facts: DataFrame, day: str, days: list[str]) -> list[tuple[str, str, int]]:
    """(output, day, differing rows) of what leaks. An output takes (facts, as of); ``day`` names the facts' column. Nothing leaks: empty."""
    found = []
    for as_of in days:
        past = facts.where(F.col(day) <= F.lit(as_of).cast("date"))
        for name, output in outputs.items():
            n = differing(output(facts, as_of), output(past, as_of))
            if n:
                found.append((name, as_of, n))
    return found


def leaking_queries(spark: SparkSession, queries: dict[str, Callable[[SparkSession, str], DataFrame]], sf_dir: str, table: str, day: str, as_of: str, others: tuple[str, ...] = ()) -> dict[str, int]:
    """Differing rows of each registered query as of a day, over a folder of tables and over one whose ``table`` ends at that day."""
    cut = releases.scratch(spark, "rewound")
    spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.col(day).cast("date") <= F.lit(as_of).cast("date")).write.parquet(f"{cut}/{table}.parquet")
    for name in others:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{cut}/{name}.parquet")
    return {name: differing(query(spark, sf_dir), query(spark, cut)) for name, query in queries.items()}


def draws(keys: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """(draw, key): n draws of the distinct keys with replacement, by a hash of seed and draw. No keys give no draws.

    Keys are sorted once; a key's rank is its place in its partition and the number of keys before that, which is one
    number for each partition. The draws, n rows, are sent to the keys.
    """
    spark = keys.sparkSession
    path = releases.scratch(spark, "ranked")
    placed = keys.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).select(key, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_place"))
    counts = sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    total, before = 0, []
    for part, count in counts:
        before.append((part, total))
        total += count
    offsets = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # a row for each partition
    told = spark.range(n).select(F.col("id").alias("draw"), F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("long").alias("_u"))
    told = told.select("draw", F.floor(F.col("_u") * F.lit(total) / F.lit(1 << 32)).cast("long").alias("_rank")) if total else told.limit(0).select("draw", F.lit(0).cast("long").alias("_rank"))
    ranked = placed.join(offsets, "_part").select(key, (F.col("_place") + F.col("_before")).alias("_rank"))
    return ranked.join(F.broadcast(told), "_rank").select("draw", key)
