"""File sources and sinks: CSV, an article cache in JSON, lists, and a paged source."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """RFC 4180 with a header; missing cells are empty."""
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, unescapedQuoteHandling="STOP_AT_DELIMITER").na.fill("")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(url, date, title, company) from one JSON object of articles by URL; one row for each company."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, struct<date: date, title: string, companies: array<string>>>").alias("m"))
    rows = raw.select(F.explode("m").alias("url", "a")).select("url", "a.date", "a.title", "a.companies")
    return rows.select("url", "date", "title", F.explode_outer(F.array_distinct("companies")).alias("company"))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the lines that are no comments."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name != '' and not startswith(name, '#')")


class PagedSource(DataSource):
    """Pages of a listing, one task each. Offline, a page is a file ``<path>/<n>.json`` of {total, items: [...]}; all must be there."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> str:
        return "id string, language string, published_at string"

    def reader(self, schema) -> DataSourceReader:
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("size", "100"))

    def _page(self, n: int) -> dict:
        with open(f"{self.path}/{n}.json") as f:
            return json.load(f)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(max(1, -(-self._page(0)["total"] // self.size)))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = self._page(partition.value)
        expected = min(self.size, page["total"] - partition.value * self.size)
        if len(page["items"]) != expected:
            raise ValueError(f"page {partition.value} has {len(page['items'])} of {expected} items")
        for x in page["items"]:
            yield x["id"], x["language"], x["published_at"]


def sheet(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(n, one column for each field) of a label sheet: a block for each line ``## A<n>``, a field for each line ``- field: value``; null where missing or empty."""
    blocks = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"(?m)^## ")).alias("place", "block")).where("place > 0")
    said = lambda k: F.nullif(F.trim(F.regexp_extract("block", rf"(?m)^- {k}:[ \t]*(.*)$", 1)), F.lit(""))
    return blocks.select(F.regexp_extract("block", r"^A?(\d+)", 1).try_cast("int").alias("n"), *[said(k).alias(k) for k in fields])
