"""The corpus pipeline: raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a frame that is
written as Parquet and read again. All but the last return the columns of the documents.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, neardup, packing, pii, quality
from tidemark.llm.common import documents, written

#: Some stages can't be expressed in SQL; the pipeline is tested against brute force instead.
ORACLE_SQL = None
#: Rows that a stage's Python workers are sent at once, at most; the session is set so: texts are long, and a worker's share of memory is small.
ROWS_AT_ONCE = 1000
#: A column of row numbers, under a name that no table has.
_ROW = "_tidemark_row"


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The documents' columns with another text, and its length where they hold it."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(c) for c in columns])


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without the lines that fail. Null and empty texts go."""
    return _with_text(quality.clean_lines(docs).where("kept"), docs.columns, "clean_text")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates on five-word shingles, that with the smallest id.

    Each row is a document of its own: rows that repeat an id are told apart by their texts, so equal ones leave one
    and unlike ones all stay. A null id is larger than all others. Texts without words stay.
    """
    named = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if written(named.select("doc_id"), "again").isEmpty():
        # ids that tell the rows apart are their numbers already
        rows, own = docs, "doc_id"
        dropped = neardup.near_duplicates(docs.select("doc_id", "text")).where("not kept").select("doc_id")
    else:
        # the row's number is written, so that every later scan sees the same one
        rows, own = written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "rows"), _ROW
        judged = neardup.near_duplicates(rows.select(F.col(_ROW).alias("doc_id"), "text"))
        member = written(rows.select(_ROW, "doc_id").join(judged.select(F.col("doc_id").alias(_ROW), "component_id"), _ROW), "member")
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _ROW))
        groups = member.groupBy("component_id").agg(F.count("*").alias("n"), first[_ROW].alias("stays")).where("n > 1").select("component_id", "stays")
        dropped = member.join(groups, "component_id").where(F.col(_ROW) != F.col("stays")).select(_ROW)
    dropped = written(dropped, "dropped")
    near = F.broadcast if neardup.fits(dropped, neardup.NearDup().broadcast) else (lambda df: df)
    return rows.join(near(dropped), own, "left_anti").select(*docs.columns)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by its kind. Null texts stay null, empty ones empty; rows that repeat stay, each masked."""
    return _with_text(pii.detect(docs), docs.columns, "masked_text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says.

    The domains are learned from the labelled rows of the raw documents, as the quality stage takes most of one domain
    out. A domain is asked for at most twice the tokens that are left of it. Rows without text have no tokens: they
    stay as they are rated, like all others; equal rows are repeated equally; no rows give none.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.resampled(mixing.mix(docs, labels, mixing.Mix(max_rise=2.0), learn_from=documents(spark, sf_dir)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. A null or empty text is its end alone; repeated rows are packed each; no rows give none."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, drops_blanks=False, keep_cache=False)


def _few_rows(stage):
    """The stage, run in a session whose workers are sent few rows at once."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if int(spark.conf.get(key)) > ROWS_AT_ONCE:
            spark.conf.set(key, str(ROWS_AT_ONCE))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _few_rows(stage)) for name, stage in (("quality", clean), ("near duplicates", one_of_each), ("personal data", mask), ("mixing", mix), ("packing", pack))]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
