"""Interval statistics, thresholds and allocations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the normal quantile of 95 %.
Z = 1.959963984540054


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of a share; 0 to 1 without trials, exact at 0 and 1."""
    k, n = k.cast("double"), n.cast("double")
    z2 = Z * Z
    centre, spread = k + z2 / 2, Z * F.sqrt(k * (n - k) / n + z2 / 4)
    low = F.when(n == 0, 0.0).when(k == 0, 0.0).otherwise((centre - spread) / (n + z2))
    high = F.when(n == 0, 1.0).when(k == n, 1.0).otherwise((centre + spread) / (n + z2))
    return low, high


def fit_threshold(items: DataFrame) -> DataFrame:
    """One row (threshold, f1, tp, fp, fn) from (score, positive, candidate): the best F1, ties to the higher threshold.

    Scores are summed to one row each first; the running sums are over distinct scores.
    """
    totals = items.agg(F.sum(F.col("positive").cast("long")).alias("positives"))
    by_score = items.where("candidate").groupBy("score").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    down = Window.orderBy(F.desc("score"))
    swept = by_score.select("score", F.sum("n").over(down).alias("predicted"), F.sum("p").over(down).alias("tp")).join(F.broadcast(totals))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("predicted") + F.col("positives"))).otherwise(F.lit(0.0))
    best = swept.withColumn("f1", f1).orderBy(F.desc("f1"), F.desc("score")).limit(1)
    return best.select(F.col("score").alias("threshold"), "f1", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("positives") - F.col("tp")).alias("fn"))


def freeze_thresholds(items: DataFrame) -> DataFrame:
    """One row (tau, tau_low) in whole hundredths from (score, positive), scores in hundredths.

    tau: the 20th percentile of the positives down to a multiple of 5, raised past every negative; tau_low: the
    highest negative and 5, up to a multiple of 5, at most tau.
    """
    a = items.agg(
        F.expr("percentile_disc(0.2) within group (order by score) filter (where positive)").alias("p20"), F.max(F.when(~F.col("positive"), F.col("score"))).alias("top")
    )
    top = F.coalesce("top", F.lit(0))
    floor5 = F.floor(F.col("p20") / 5).cast("long") * 5
    tau = F.least(F.lit(100), F.greatest(floor5, F.when(floor5 > top, floor5).otherwise((F.floor(top / 5).cast("long") + 1) * 5))).cast("long")
    return a.select(tau.alias("tau"), F.least(tau, (F.ceil((top + 5) / 5) * 5).cast("long")).alias("tau_low"))


def allocation(spark: SparkSession, both: int, rules: int, model: int, n: int = 30, least: int = 10) -> DataFrame:
    """One row (b, r, m): ``n`` items over three strata, nearest to proportional, each system with ``least``.

    A grid of candidates, a few hundred rows; ties go to the smallest b, then r.
    """
    total = max(1, both + rules + model)
    grid = spark.range(n + 1).select(F.col("id").alias("b")).join(spark.range(n + 1).select(F.col("id").alias("r")), F.expr(f"b + r <= {n}")).withColumn("m", F.lit(n) - F.col("b") - F.col("r"))
    ok = (F.col("b") <= both) & (F.col("r") <= rules) & (F.col("m") <= model) & (F.col("b") + F.col("r") >= least) & (F.col("b") + F.col("m") >= least)
    for name, size in (("b", both), ("r", rules), ("m", model)):
        ok = ok & (F.col(name) >= (1 if size else 0))
    cost = sum(((F.col(c) - F.lit(n * size / total)) * (F.col(c) - F.lit(n * size / total)) for c, size in (("b", both), ("r", rules), ("m", model))), F.lit(0.0))
    return grid.where(ok).orderBy(F.round(cost, 9), "b", "r").limit(1).select("b", "r", "m")
