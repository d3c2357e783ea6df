"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without blanks at both ends, A to Z lower-cased; its hash has 128 bits. A run is a table of
distinct hashes, bucketed and sorted by them. A new batch of documents is reduced to its distinct hashes and
merge-anti-joined with all runs: what no run holds is a line's first sight, and its holder is the batch's largest
doc_id that has it; what a run holds is seen again. Both are written as a run of level 0, with the number of
documents. When a level has ``fan`` runs they are compacted into one of the next level, so a batch meets few runs
however many came before it. Batches are taken by falling doc_id, so a line's holder is the largest doc_id of all.

In the end, lines in at least ``min_docs`` documents go from all documents but their holder. Neither the texts nor
the lines are gathered by line: a line that is everywhere is one row for each task of a batch.

Edge cases: a null or empty text is one empty line; lines under ``min_chars`` code points stay; a line repeated inside
a document counts once, and all its repeats go or stay with it; rows of one doc_id are one document, rows with a null
id are one that is smaller than all others; the rows of the result are those of the input; an empty table gives none;
further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, as_bytes, shared_dir, shuffle_parts, written

HASH = ("line_hi", "line_lo")
RUN = "line_hi long, line_lo long, holder long, first boolean, n_docs long"


@dataclass(frozen=True)
class LineDedup:
    #: Code points that a key needs to be looked at.
    min_chars: int = 40
    #: Documents that a key must be in to be dropped.
    min_docs: int = 5
    #: Batches that a table is dealt into, by ranges of doc_id.
    batches: int = 6
    #: Runs of a level that are compacted into one.
    fan: int = 3


def line_hash(line: bytes, how: LineDedup) -> tuple[int, int] | None:
    """The hash of a line's key as two signed 64-bit integers; None where the key is too short."""
    key = line.strip(BLANKS)
    if len(key) < how.min_chars or (not key.isascii() and len(key.decode()) < how.min_chars):
        return None
    x = xxhash.xxh3_128_digest(key.lower())
    return int.from_bytes(x[:8], "big", signed=True), int.from_bytes(x[8:], "big", signed=True)


def line_hashes(docs: DataFrame, how: LineDedup) -> DataFrame:
    """(doc_id, row, line_hi, line_lo), one for each distinct key of a row's text; ``row`` tells apart rows of one doc_id."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), *((h, pa.int64()) for h in HASH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, hi, lo = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                for x in {line_hash(line, how) for line in text.split(b"\n")} - {None}:
                    ids.append(doc), rows.append(row), hi.append(x[0]), lo.append(x[1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, rows, hi, lo)], schema=schema)

    return docs.select("doc_id", F.xxhash64("text").alias("row"), "text").mapInArrow(run, "doc_id long, row long, line_hi long, line_lo long")


class LineRuns:
    """Levels of runs, as managed tables of a database of their own below the shared folder."""

    def __init__(self, spark: SparkSession, how: LineDedup = LineDedup()):  # noqa: B008
        self.spark, self.how, self.count = spark, how, 0
        self.database, self.location = f"tidemark_lines_{uuid.uuid4().hex}", shared_dir(spark, "line-runs")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.location}'")
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        name = f"run_{self.count}"
        self.count += 1
        run.write.bucketBy(shuffle_parts(self.spark), *HASH).sortBy(*HASH).saveAsTable(f"{self.database}.{name}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        """One run of several: the holder from the run that saw the line first, and the documents of all.

        They are read as one scan of their files: Spark 4.1 takes a union of bucketed tables for partitioned by the
        bucket, and so leaves out an exchange that it needs.
        """
        every = self.spark.read.schema(RUN).parquet(*[f"{self.location}/{n}" for n in names]) if names else self.spark.createDataFrame([], RUN)
        return every.groupBy(*HASH).agg(F.max_by("holder", "first").alias("holder"), F.max("first").alias("first"), F.sum("n_docs").alias("n_docs"))

    def add(self, batch: DataFrame) -> None:
        """Takes in the line hashes (doc_id and HASH) of documents smaller than all that came before."""
        fresh = batch.select("doc_id", *HASH).distinct().groupBy(*HASH).agg(F.max("doc_id").alias("holder"), F.count(F.lit(1)).alias("n_docs"))
        first = F.lit(True)
        for k, name in enumerate(self.names()):
            # a run is bucketed by the hash: only the batch is exchanged
            run = self.spark.table(f"{self.database}.{name}").select(*HASH, F.lit(True).alias(f"in_{k}"))
            fresh = fresh.join(run.hint("merge"), [*HASH], "left")
            first = first & F.col(f"in_{k}").isNull()
        self._write(fresh.select(*HASH, F.when(first, F.col("holder")).alias("holder"), first.alias("first"), "n_docs"), 0)
        for level, names in enumerate(self.levels):
            if len(names) >= self.how.fan:
                self._write(self._merged(names), level + 1)
                self.levels[level] = []
                for name in names:
                    self.spark.sql(f"DROP TABLE {self.database}.{name}")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def frequent(self) -> DataFrame:
        """(line_hi, line_lo, holder) of the lines in at least ``min_docs`` documents."""
        return self._merged(self.names()).where(F.col("n_docs") >= self.how.min_docs).select(*HASH, "holder")

    def close(self) -> None:
        """Deletes all runs."""
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def _dealt(docs: DataFrame, batches: int):
    """A column with the number of a document's batch: 0 for the largest doc_ids; null ids are in the last."""
    shares = [k / batches for k in range(1, batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 100 * batches)).first()[0] or [] if shares else []
    number = F.lit(0)
    for bound in sorted(set(bounds)):
        number = number + (F.col("doc_id") <= bound).cast("int")
    return F.coalesce(number, F.lit(len(set(bounds))))


def dedup_lines(docs: DataFrame, how: LineDedup = LineDedup()) -> DataFrame:  # noqa: B008
    """(doc_id, kept_text, n_lines, n_dropped) of every row; lines that stay are joined by a newline."""
    spark = docs.sparkSession
    hashes = line_hashes(docs, how).withColumn("batch", _dealt(docs, how.batches)).repartition("doc_id", *HASH)
    hashes = written(hashes, "line-hashes", ["batch"])
    runs = LineRuns(spark, how)
    for number in range(how.batches):
        runs.add(hashes.where(F.col("batch") == number))
    frequent = written(runs.frequent(), "frequent-lines")
    runs.close()
    gone = hashes.join(frequent, [*HASH]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = gone.groupBy(F.col("doc_id").alias("of_doc"), F.col("row").alias("of_row")).agg(F.collect_set(F.struct(*HASH)).alias("gone"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    rows = rows.join(written(gone, "lines-to-drop"), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("row") == F.col("of_row")), "left")
    schema = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = stay = text.split(b"\n")
                if drop:
                    drop = {(x["line_hi"], x["line_lo"]) for x in drop}
                    stay = [line for line in lines if line_hash(line, how) not in drop]
                kept.append(b"\n".join(stay)), n_lines.append(len(lines)), n_dropped.append(len(lines) - len(stay))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines), pa.array(n_dropped)], schema=schema)

    return rows.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, kept_text string, n_lines long, n_dropped long")
