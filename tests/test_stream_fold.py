"""The fold as a stream equals the fold as a batch, row by row, over several micro-batches and a restart."""

import random

from pyspark.sql import functions as F

from tidemark.operators import history
from tidemark.sources import tables
from tidemark.streaming import folding

SF = "/root/testdata/sf0.001"


def rows(spark):
    """The events table in the fold's roles, of some users."""
    e = tables.table(spark, SF, "events").where("user_id % 10 = 0")
    k = F.get_json_object("props", "$.k").cast("int")
    on = lambda t, c: F.when(F.col("event_type") == t, c)
    return e.select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), on("purchase", F.col("value").cast("decimal(18,2)")).alias("step"), on("click", k < 80).alias("state"),
        ((F.col("event_type") == "view") & (k < 5)).alias("converts"), (F.col("event_type") == "signup").alias("forms"),
    )


def test_stream_equals_batch(spark, tmp_path):
    every = rows(spark)
    want = history.fold(every, "key", ["at", "id"], F.col("step"), F.col("state"), F.col("converts"), F.col("forms"), "at")
    want = {(r.key, r.id): (r.prev_amount, r.in_force, r.converted, r.founded) for r in want.collect()}
    assert len(want) > 60
    # three files by time, with late rows moved to the next one; then rows far ahead, which push the watermark past all others
    rng = random.Random(1)
    told = sorted(every.collect(), key=lambda r: r.at)
    parts = [[], [], []]
    for n, r in enumerate(told):
        part = 3 * n // len(told)
        parts[min(2, part + (rng.random() < 0.2))].append(r)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    stream = lambda: folding.fold_stream(spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(source), "40 days")

    def run():
        q = stream().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()

    for n, part in enumerate(parts[:2]):
        rng.shuffle(part)
        spark.createDataFrame(part, every.schema).coalesce(1).write.mode("append").parquet(source)
        if n == 1:
            run()  # two micro-batches; what comes next starts the query again
    spark.createDataFrame(parts[2], every.schema).coalesce(1).write.mode("append").parquet(source)
    run()
    ahead = every.limit(1).select("key", F.lit(-1).cast("long").alias("id"), F.expr("timestamp'2030-01-01'").alias("at"), "step", "state", "converts", "forms")
    spark.createDataFrame(ahead.collect(), every.schema).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    got = spark.read.parquet(out).collect()
    assert len(got) == len({(r.key, r.id) for r in got})
    assert {(r.key, r.id): (r.prev_amount, r.in_force, r.converted, r.founded) for r in got} == want
