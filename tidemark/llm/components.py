"""Connected components of a link table by contraction, in DataFrame operations.

A round lets each component hook to its smallest smaller neighbour, shortens the chains until they end in roots,
and draws the links anew between roots. Each round at least halves the components that have links. Tables between
rounds are written to the shared folder; the driver sees counts alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import counted


def _drawn(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _halved(parents: DataFrame) -> DataFrame:
    """(id, parent, moved): each id hooked to its parent's parent, where that has one."""
    up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
    return parents.join(up, "parent", "left").select("id", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved"))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b); the component is the smallest id that can be reached.

    Links of an id to itself count as naming the id. An empty table gives none.
    """
    links, n = counted(_drawn(links), "links")
    labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    left = links.where("a < b")
    while n:
        parents = left.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        parents, n = counted(_halved(parents), "parents")
        while n and not parents.where("moved").isEmpty():  # until all parents are roots
            parents, _ = counted(_halved(parents.drop("moved")), "parents")
        root = parents.select(F.col("id").alias("component"), "parent")
        labels = labels.join(root, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
        if not n:
            break
        of = lambda c: parents.select(F.col("id").alias(c), F.col("parent").alias(f"root_{c}"))
        roots = left.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        left, n = counted(_drawn(roots.where("a != b")), "links")
    return labels
