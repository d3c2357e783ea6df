"""The operators' queries over the synthetic tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import align, katz, langid, linededup, mixing, neardup, packing, pii, quality, sketch, spelling, tokens, urls
from tidemark.llm.common import documents, remainder


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokens.write_token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1, drops_blanks=True)
    return tokens.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sketched = lambda df: sketch.with_sketch(df, "text", "sketch").withColumn("carried", F.struct("text", "sketch"))
    pairs = sketch.with_next(docs, "carried", sketched).drop("carried")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    both = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    both = sketch.with_sketch(both, "edited", "edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch.fingerprint(F.col("sketch")).alias("fingerprint"), sketch.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketch.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), sketch.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, drops_blanks=False)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(documents(spark, sf_dir).select("doc_id", "text"), with_text=False).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.rates(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rates.select("doc_id", "n_tokens", *[f"p_{d}" for d in mixing.DOMAINS], "rate", "targets_met")


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), neardup.NearDup(shingle=2))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir).select("doc_id", "text"), with_text=False).drop("text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, profile = langid.prototypes(langid.learn(docs, F.coalesce(remainder(F.col("doc_id"), 5) != 0, F.lit(True))))
    out = langid.identify(docs, langs, profile)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


URL_RULES = [urls.Rule("allow", "org/"), urls.Rule("block", "example.org/es/"), urls.Rule("block", "example.org/en/1"), urls.Rule("allow", "com/fr/"), urls.Rule("block", "com/de/")]


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.spelling_variants(documents(spark, sf_dir), noise=31)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_files, op2_fingerprints, op3_katz, op4_packing, op5_quality, op6_mixing, op7_neardup, op8_personal_data, op9_language, op10_urls, op11_alignment, op12_spelling, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    """None of them can be said in SQL whole; they are tested against brute force."""
    return {}
