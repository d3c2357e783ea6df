"""Versioned releases: partitions written first, gates, then one pointer moved.

A release is a partition of each table. Readers resolve the pointer once and see one release. The pointer and
the headers are small tables of their own, written through Spark, so they can lie in any store.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import clauses as clause
from tidemark.operators import names as listed
from tidemark.sources import files

#: Fixed value: the highest rate of failures a release may have.
MAX_RATE = 0.05


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table between steps, below the folder that all machines share (spark.checkpoint.dir).

    Only where that is unset and all runs on one machine, as in tests, a temporary folder is set for the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def to_prune(headers: DataFrame, keep: int) -> DataFrame:
    """(id) of what may go: all but the current release, those being built, and the newest ready ones."""
    number = F.substring("id", 2, 10).cast("int")
    ready = headers.where("status = 'ready' and not is_current").withColumn("_n", F.row_number().over(Window.orderBy(number.desc())))
    stay = ready.where(F.col("_n") <= keep - 1).select("id")
    return headers.where("status != 'building' and not is_current").select("id").join(stay, "id", "left_anti")


def next_id(headers: DataFrame) -> DataFrame:
    return headers.agg(F.concat(F.lit("r"), (F.coalesce(F.max(F.substring("id", 2, 10).cast("int")), F.lit(0)) + 1).cast("string")).alias("next_id"))


def gates(counters: dict[str, float], missing_days: int, span_violations: int, has_eval: bool) -> list[str]:
    """The gates that fail."""
    rate = lambda a, b: counters.get(a, 0) / counters[b] if counters.get(b) else 0.0
    tests = {
        "parse_failures": rate("parse_failures", "publications") > MAX_RATE, "scorer_errors": rate("scorer_errors", "candidates") > MAX_RATE,
        "missing_days": missing_days > 0, "span_violations": span_violations > 0, "no_evaluation": not has_eval,
    }
    return [name for name, failed in tests.items() if failed]


def same_system(measured: Column, current: Column, parts: list[str]) -> Column:
    """Whether an evaluation measured the current system: all parts equal, nulls included; nothing measured is another system."""
    equal = reduce(lambda a, b: a & b, [measured[p].eqNullSafe(current[p]) for p in parts])
    return measured.isNotNull() & equal


def personal_cells(rows: DataFrame, rules: dict[str, str] | None = None, names: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """(row, cell, rule) of every cell that fits a rule of personal data or holds a listed name (n, name) of four characters or more.

    Without ``rules`` the five of the gate. Rows are numbered as they come. Cells of the columns in ``skip`` are not looked at.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), *[c for c in rows.columns if c != "_row"])
    every = listed.cells(numbered, "_row", skip)
    met = clause.personal_data(F.col("value")) if rules is None else F.array_compact(F.array(*[F.when(F.col("value").rlike(p), F.lit(r)) for r, p in rules.items()]))
    hits = every.select(F.col("_row").alias("row"), "cell", F.explode(met).alias("rule"))
    if names is not None:
        found = listed.occurrences(every, names, anywhere=True).select(F.col("_row").alias("row"), "cell").distinct()
        hits = hits.unionByName(found.withColumn("rule", F.lit("listed person name")))
    return hits


def export(rows: DataFrame, path: str, rules: dict[str, str] | None = None, names: DataFrame | None = None, skip: tuple[str, ...] = ()) -> int:
    """Writes rows as CSV if no cell fails the gate of personal data; returns the number of hits, and writes nothing if there are any.

    The rows are staged beside the path first, so what is checked is what is written.
    """
    spark = rows.sparkSession
    staging = f"{path.rstrip('/')}.staging"
    rows.write.mode("overwrite").parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    found = personal_cells(staged, rules, names, skip).count()
    if not found:
        files.write_csv(staged, path)
    return found


class CommitLog:
    """Numbered entries below a path, a file each, that are created only if their number is free.

    Two writers that want one number can't both have it: creating the file is exclusive, and who comes second takes the
    next number. An entry that a lost writer left unfinished is no JSON yet and counts as none, though its number stays taken.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _store(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        where = hadoop.Path(self.path)
        return hadoop, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        hadoop, store = self._store()
        where = hadoop.Path(self.path)
        names = [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def take(self, number: int, entry: dict) -> bool:
        """Creates the entry with just this number; False if it is taken."""
        hadoop, store = self._store()
        path, data = f"{self.path}/{number:010d}.json", json.dumps(entry).encode()
        store.mkdirs(hadoop.Path(self.path))
        if store.getScheme() == "file":
            try:
                with open(store.makeQualified(hadoop.Path(path)).toUri().getPath(), "xb") as f:
                    f.write(data)
            except FileExistsError:
                return False
            return True
        try:
            out = store.create(hadoop.Path(path), False)
        except Py4JJavaError as e:
            if not store.exists(hadoop.Path(path)):
                raise ValueError(f"{path} could not be written") from e
            return False
        out.write(bytearray(data))
        out.close()
        return True

    def append(self, entry: dict) -> int:
        """The number that the entry got."""
        number = max(self._numbers(), default=0) + 1
        while not self.take(number, entry):
            number += 1
        return number

    def entries(self) -> DataFrame:
        """The finished entries, ``at`` being their numbers."""
        if not self._numbers():
            return self.spark.createDataFrame([], f"{self.schema}, at long")
        read = self.spark.read.schema(f"{self.schema}, _corrupt_record string").option("pathGlobFilter", "[0-9]*.json").json(self.path)
        rows = read.select("*", F.regexp_extract("_metadata.file_name", "^([0-9]+)", 1).cast("long").alias("at"))
        return rows.where("_corrupt_record is null").drop("_corrupt_record")


class Store:
    """Tables below a path, partitioned by ``release_id``; headers and the pointer are logs of commits."""

    #: Tables whose rows refer to others come first when a release is deleted.
    CHILDREN_FIRST = ("confirmations", "assessments", "events", "names")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._headers = CommitLog(spark, f"{self.path}/headers", "id string, status string, note string, evaluation string")
        self._pointer = CommitLog(spark, f"{self.path}/pointer", "release_id string")

    def headers(self) -> DataFrame:
        """(id, status, note, evaluation, is_current): the latest status of each release, and what was last said of it."""
        log = self._headers.entries()
        last = log.groupBy("id").agg(F.max_by("status", "at").alias("status"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in ("note", "evaluation")])
        return last.withColumn("is_current", F.coalesce(F.col("id") == F.lit(self.current()), F.lit(False)))

    def current(self) -> str | None:
        """The live release: the pointer's last entry."""
        return self._pointer.entries().agg(F.max_by("release_id", "at").alias("r")).first()["r"]

    def mark(self, release: str, status: str, note: str | None = None, evaluation: str | None = None) -> int:
        return self._headers.append({"id": release, "status": status, "note": note, "evaluation": evaluation})

    def stage(self, release: str, rows: dict[str, DataFrame]) -> None:
        """Writes the rows as the release's partitions; nobody reads them yet. Running again replaces them. A write that fails marks the release as failed."""
        self.mark(release, "building")
        try:
            for name, df in rows.items():
                df.withColumn("release_id", F.lit(release)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release_id").parquet(f"{self.path}/{name}")
        except Exception as e:
            self.mark(release, "failed", f"write failed: {str(e)[:300]}")
            raise

    def close(self, release: str, failures: list[str], evaluation: str | None = None) -> bool:
        """Marks what was staged, and moves the pointer to it if no gate failed."""
        self.mark(release, "failed" if failures else "ready", ", ".join(failures) or None, evaluation)
        if not failures:
            self.activate(release)
        return not failures

    def write(self, release: str, rows: dict[str, DataFrame], failures: list[str]) -> bool:
        """Stages the rows and closes the release."""
        self.stage(release, rows)
        return self.close(release, failures)

    def activate(self, release: str) -> None:
        """Also a rollback; only to a release that is ready."""
        if self.headers().where((F.col("id") == release) & (F.col("status") == "ready")).isEmpty():
            raise ValueError(f"{release} is not ready")
        self._pointer.append({"release_id": release})

    def prune(self, keep: int, tables: tuple[str, ...] = CHILDREN_FIRST) -> list[str]:
        """Deletes the partitions of old releases, children first; returns their ids.

        Each is marked before anything of it goes, so nobody can go back to it, and a prune that died is taken up by the next one.
        """
        hadoop, store = self._headers._store()
        stay = self.headers().where("status <> 'pruned'")
        gone = sorted(r.id for r in to_prune(stay, keep).collect())
        for release in gone:
            self.mark(release, "pruning")
        for name in tables:
            for release in gone:
                store.delete(hadoop.Path(f"{self.path}/{name}/release_id={release}"), True)
        for release in gone:
            self.mark(release, "pruned")
        return gone

    def read(self, name: str, release: str | None = None) -> DataFrame:
        """A table of the live release, or of another; the partition filter reaches the scan."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("release_id") == (release or self.current()))
