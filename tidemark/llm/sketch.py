"""Threshold-scaled document sketches, in DataFrame functions alone.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So the sketch of a union is the
union of the sketches, and how much of one document another contains can be estimated whatever their sizes.
Beside the sketch stands the least hash of all. It tells short texts apart of which no hash is below the
threshold; the least hash of a union is the lesser one.

Edge cases: a null text is empty; a text with fewer words than a shingle is one shingle of all of them; a
text without words has an empty sketch and no least hash, and is like only to another such; repeated rows
have equal sketches and stand next to each other in the order of ``doc_id``; rows with a null id come first; an
empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_parts, written

SHINGLE = 5
#: One hash in so many is kept.
SCALE = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_hashes(text: Column) -> Column:
    words = F.split(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of ``size`` words; of all words as one shingle if they are fewer."""
    n = F.size(words)
    at = F.sequence(F.lit(0), n - size)
    many = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64(words))).otherwise(many)


def sketch(hashes: Column, scale: int = SCALE) -> Column:
    """The sorted distinct hashes in the lowest 1 / ``scale`` of the range."""
    limit = -(1 << 63) + ((1 << 64) // scale)
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < F.lit(limit))))


def with_sketch(docs: DataFrame, text: str, name: str, size: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """``docs`` with ``name`` (low, least), the sketch and the least hash of a text column; the steps are columns of their own, so each is computed once."""
    told = docs.withColumn("_words", word_hashes(F.col(text))).withColumn("_hashes", shingle_hashes(F.col("_words"), size)).drop("_words")
    return told.withColumn(name, F.struct(sketch(F.col("_hashes"), scale).alias("low"), F.array_min("_hashes").alias("least"))).drop("_hashes")


def fingerprint(sketched: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash, or for the least hash if no other is kept."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.when(F.size(sketched["low"]) > 0, F.array_join(F.transform(sketched["low"], digits), "")).otherwise(F.coalesce(digits(sketched["least"]), F.lit("")))


def containment(of: Column, within: Column) -> Column:
    """The share of one sketch's hashes that the other holds; if it has none, whether the least hashes are equal."""
    common = F.size(F.array_intersect(of["low"], within["low"]))
    return F.when(F.size(of["low"]) == 0, of["least"].eqNullSafe(within["least"]).cast("double")).otherwise(common / F.size(of["low"]))


def resemblance(a: Column, b: Column) -> Column:
    """The same of two arrays of hashes, over those that either holds."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def with_next(docs: DataFrame, carried: str, derive: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Every row of ``derive(docs)`` with ``next``: the column ``carried`` of the row that follows by (doc_id, text); the first follows the last.

    Ranges of ``doc_id`` from its quantiles, a few for each task, are ordered each. A range's last row takes the
    first row of the next range. One exchange of the texts. The ranges' first rows, one each, are found by their
    ids and looked up apart, and only they are derived again.
    """
    spark = docs.sparkSession
    ranges = 8 * shuffle_parts(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges).alias("q")).first()["q"]
    cuts = sorted(set(cuts or []))
    edges = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<bigint>")
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(cuts).bit_length())))])
    place = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get(edges, at + half - 1) <= F.col("doc_id"), at + half).otherwise(at))
    order = Window.partitionBy("_range").orderBy("doc_id", "text")
    ranged = derive(docs).withColumn("_range", place)
    inner = ranged.withColumn("_next", F.lead(carried).over(order)).withColumn("_more", F.lead(F.lit(True), 1, False).over(order))
    # one row for each range: its first id, null if it has rows without one
    ids = docs.select("doc_id", place.alias("_range")).groupBy("_range").agg(F.when(F.max(F.col("doc_id").isNull()), F.lit(None).cast("long")).otherwise(F.min("doc_id")).alias("_id"))
    ids = written(ids, "ranges")
    texts = docs.join(F.broadcast(ids), docs["doc_id"].eqNullSafe(ids["_id"])).groupBy("_range", F.col("_id").alias("doc_id")).agg(F.min("text").alias("text"))
    firsts = derive(texts).select(F.col("_range").alias("_of"), F.col(carried).alias("_first"))
    ring = Window.orderBy("_range")
    before = ids.select(F.coalesce(F.lag("_range").over(ring), F.max("_range").over(Window.partitionBy())).alias("_range"), F.col("_range").alias("_of"))
    following = written(before.join(firsts, "_of").select("_range", "_first"), "firsts")
    joined = inner.join(following, "_range", "left")
    return joined.withColumn("next", F.when(F.col("_more"), F.col("_next")).otherwise(F.col("_first"))).drop("_range", "_next", "_more", "_first")
