"""Resumable ingest with a look-back: a run may die between any two writes and be run again.

A run has a key. What it has to do is the listing's window, from some days before the newest stored publication to today,
less what this key has done. Publications are appended by id, then each item's attempt is appended under the key and the
attempt's number; both are idempotent, so running again after a death gives the tables of one clean run. Another key tries
all of its window again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

ATTEMPT = "run string, item string, attempt int, status string, error string"
#: Fixed value: days before the newest stored publication that are listed again, as entries may come late.
LOOK_BACK = 7


@dataclass(frozen=True)
class Taken:
    """What a run listed, had left to do, stored anew and failed at."""

    listed: int
    todo: int
    new: int
    failed: int


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def add_new(rows: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not stored, one for each key; returns how many there were.

    A null key is no key: such rows are left out. The rows are kept while they are counted and written, so both are of the same ones.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    stored = _table(rows.sparkSession, path, schema).select(key)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored, key, "left_anti").select(*rows.columns).persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").parquet(path)
    finally:
        fresh.unpersist()
    return n


class Ingest:
    """Tables below a path: ``publications`` by id, and ``attempts``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        """``schema`` is that of a publication: it has id and published_at."""
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def publications(self) -> DataFrame:
        return _table(self.spark, f"{self.path}/publications", self.schema)

    def attempts(self) -> DataFrame:
        """Each attempt once, whoever wrote it again."""
        return _table(self.spark, f"{self.path}/attempts", ATTEMPT).dropDuplicates(["run", "item", "attempt"])

    def checkpoints(self, run: str) -> DataFrame:
        """(item, status, attempts, error): the last attempt of each item of a run."""
        last = F.max_by(F.struct("status", "error"), "attempt")
        return self.attempts().where(F.col("run") == run).groupBy("item").agg(last.alias("l"), F.max("attempt").alias("attempts")).select("item", "l.status", "attempts", "l.error")

    def window(self, listing: DataFrame, first: str, today: str) -> DataFrame:
        """The listing's items from ``LOOK_BACK`` days before the newest stored publication, or from ``first``, to today."""
        newest = self.publications().agg(F.max("published_at").alias("newest"))
        start = F.coalesce(F.date_sub(F.col("newest"), LOOK_BACK), F.lit(first).cast("date"))
        # one row is sent to the listing
        return listing.join(F.broadcast(newest.select(start.alias("_start"))), F.col("published_at").between(F.col("_start"), F.lit(today).cast("date"))).drop("_start").dropDuplicates(["id"])

    def run(self, run: str, listing: DataFrame, fetched: DataFrame, first: str, today: str, retries: int = 3) -> Taken:
        """One run over a listing (id, published_at, ...). ``fetched`` has the publications that can be had (``schema``); an item without one fails.

        Items that this run has done, or failed at ``retries`` times, are not tried again. The window is fixed by the run's
        first attempt: what a run stored before it died does not shorten what it has to do.
        """
        plan = f"{self.path}/runs/run={run}"
        columns = "id string, published_at date"
        try:
            items = self.spark.read.schema(columns).parquet(plan)
        except AnalysisException:
            # written at once or not at all: a folder without its success mark is written again
            self.window(listing, first, today).select("id", "published_at").write.mode("overwrite").parquet(plan)
            items = self.spark.read.schema(columns).parquet(plan)
        before = self.checkpoints(run)
        over = before.where((F.col("status") == "done") | (F.col("attempts") >= retries)).select(F.col("item").alias("id"))
        todo = items.join(over, "id", "left_anti").persist()
        try:
            todo.count()  # before anything is written, which would make Spark compute it anew
            got = fetched.join(todo.select("id"), "id", "left_semi")
            new = add_new(got.select(*[f.split()[0] for f in self.schema.split(", ")]), f"{self.path}/publications", "id")
            stored = self.publications().select("id", F.lit(True).alias("_stored"))
            tried = todo.join(stored, "id", "left").join(before.select(F.col("item").alias("id"), "attempts"), "id", "left")
            status = F.when(F.col("_stored"), "done").otherwise("failed")
            rows = tried.select(F.lit(run).alias("run"), F.col("id").alias("item"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"), status.alias("status"), F.when(F.col("_stored").isNull(), "not fetched").alias("error"))
            seen = Observation(f"attempts-{uuid.uuid4().hex}")
            rows.observe(seen, F.count(F.lit(1)).alias("todo"), F.count_if(F.col("status") == "failed").alias("failed")).write.mode("append").parquet(f"{self.path}/attempts")
            return Taken(items.count(), seen.get["todo"], new, seen.get["failed"])
        finally:
            todo.unpersist()


def by_query(found: DataFrame, keys: DataFrame) -> DataFrame:
    """(keyword, language, n) of what each query of a list found, before repeats are dropped; a query that found nothing has 0."""
    counted = found.groupBy("keyword", "language").agg(F.count("*").alias("n"))
    return keys.join(counted, ["keyword", "language"], "left").select("keyword", "language", F.coalesce("n", F.lit(0)).alias("n"))


def first_of_each(found: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first by the order."""
    w = Window.partitionBy(key).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
