"""Deterministic draws: orders by hash, exact sizes for each stratum, partitions that no key crosses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, key: Column) -> Column:
    """The same order in any engine: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), key.cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: str) -> DataFrame:
    """Exactly the wanted number of rows of each stratum, or all there are.

    A stratum's first rows are found from partial tops: each of 64 salts keeps its own first, then the rest meet.
    """
    rank = F.struct(hash_order(seed, F.col(key)).alias("h"), F.col(key).alias("k"))
    want = F.lit(0)
    for name, n in sizes.items():
        want = F.when(F.col(stratum) == name, n).otherwise(want)
    salted = df.withColumn("_rank", rank).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(64)))
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy(stratum, "_salt").orderBy("_rank"))).where(F.col("_n") <= want)
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(stratum).orderBy("_rank"))).where(F.col("_n") <= want).drop("_rank", "_salt", "_n")


def generator(seed: int):
    """mulberry32, a public 32-bit generator of numbers from 0 to 1, for small lists on the driver."""
    state = seed & 0xFFFFFFFF

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        x = ((state ^ state >> 15) * (state | 1)) & 0xFFFFFFFF
        x ^= (x + ((x ^ x >> 7) * (x | 61))) & 0xFFFFFFFF
        return ((x ^ x >> 14) & 0xFFFFFFFF) / 2**32

    return draw


def shuffled(items: Sequence, seed: int) -> list:
    """A seeded permutation, swapping from the end."""
    out, draw = list(items), generator(seed)
    for k in range(len(out) - 1, 0, -1):
        j = int(draw() * (k + 1))
        out[k], out[j] = out[j], out[k]
    return out
