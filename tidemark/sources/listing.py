"""A windowed listing as a data source: it is told keywords, sub-rubrics and days, and reads no page it need not.

A landed listing is a folder for each keyword and range of days, ``<path>/<keyword>/<first>_<last>/<page>.json``, each page
{total, items: [{id, language, subRubric, publicationDate, title}]}. Keywords and days choose the folders, a page is one
partition, and what a folder holds must add up to the total that its pages tell, or the read fails. Paths are those
of any file system that pyarrow knows by its scheme.

The window is an option of the load. Without one, filters are pushed where the session sets spark.sql.python.filterPushdown.enabled.
Spark 4.1 keeps one set of pushed filters for each load and uses it for all scans of that load, unfiltered ones too: such a
load is for one set of filters only. A load with a window takes no pushed filters, so any plan may use it as it likes.

Edge cases: a window that nothing landed for is an error, not an empty list; null values of an item are kept as they are; an
item that several folders hold comes several times.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from tidemark.operators import ingest

# The ingest's queries, its rubric, and the days of a range that is listed at once.
QUERIES = (("Aktienkapital", "de"), ("capital-actions", "fr"), ("Kapitalband", "de"), ("marge de fluctuation", "fr"), ("Umwandlung", "de"), ("transformée", "fr"))
SUB_RUBRICS, CHUNK_DAYS = ("HR02",), 31
_RANGE = re.compile(r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})")
SCHEMA = "keyword string, id string, language string, sub_rubric string, published_at date, title string"


@dataclass
class Page(InputPartition):
    keyword: str
    file: str
    page: int
    total: int
    pages: int


class ListingSource(DataSource):
    """``spark.read.format("tidemark_listing").load(path)``; the option ``window`` is JSON of keywords, rubrics, first and last."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        window = self.options.get("window")
        return _PushedReader(self.options["path"]) if window is None else _Reader(self.options["path"], window)


class _Reader(DataSourceReader):
    def __init__(self, path: str, window: str | None = None):
        self.path = path
        self.keywords: set[str] | None = None
        self.rubrics: set[str] | None = None
        self.first, self.last = date.min, date.max
        self.filled: set[str] = set()
        if window is not None:
            told = json.loads(window)
            self.keywords, self.rubrics = set(told["keywords"]), set(told["rubrics"])
            self.first, self.last = date.fromisoformat(told["first"]), date.fromisoformat(told["last"])

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def _load(self, store, file: str) -> dict:
        with store.open_input_stream(file) as f:
            return json.loads(f.read())

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = self._store()
        out: list[InputPartition] = []
        for folder in store.get_file_info(fs.FileSelector(root)):
            if folder.type != fs.FileType.Directory or (self.keywords is not None and folder.base_name not in self.keywords):
                continue
            for days in store.get_file_info(fs.FileSelector(folder.path)):
                m = _RANGE.fullmatch(days.base_name)
                if not m or date.fromisoformat(m[1]) > self.last or date.fromisoformat(m[2]) < self.first:
                    continue
                files = sorted((x.path for x in store.get_file_info(fs.FileSelector(days.path)) if x.base_name.removesuffix(".json").isdigit()), key=lambda p: int(p.rpartition("/")[2].removesuffix(".json")))
                if not files:
                    raise ValueError(f"{days.path} has no pages")
                first = self._load(store, files[0])
                size = max(1, len(first["items"]))
                if -(-first["total"] // size) > len(files):
                    raise ValueError(f"{days.path} has {len(files)} pages of {-(-first['total'] // size)}")
                out += [Page(folder.base_name, file, k, first["total"], size) for k, file in enumerate(files)]
        return out

    def read(self, partition: Page) -> Iterator[tuple]:
        store, _ = self._store()
        page = self._load(store, partition.file)
        expected = max(0, min(partition.pages, partition.total - partition.page * partition.pages))
        if page["total"] != partition.total or len(page["items"]) != expected:
            raise ValueError(f"{partition.file} has {len(page['items'])} of {expected} items, {page['total']} of {partition.total} in all")
        for x in page["items"]:
            day = date.fromisoformat(x["publicationDate"][:10]) if x.get("publicationDate") else None
            # a filter that was taken is answered here; a null answers none
            if (self.first, self.last) != (date.min, date.max) and (day is None or not self.first <= day <= self.last):
                continue
            if ("published_at" in self.filled and day is None) or ("sub_rubric" in self.filled and x.get("subRubric") is None):
                continue
            if self.rubrics is None or x.get("subRubric") in self.rubrics:
                yield partition.keyword, x.get("id"), x.get("language"), x.get("subRubric"), day, x.get("title")


class _PushedReader(_Reader):
    """The reader of a load without a window."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        """Whether the source answers the filter itself."""
        column = getattr(f, "attribute", ("",))
        if isinstance(f, IsNotNull) and column in (("keyword",), ("sub_rubric",), ("published_at",)):
            self.filled.add(column[0])
            return True
        values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
        if column == ("published_at",):
            if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                self.first = max(self.first, f.value)
            if isinstance(f, (EqualTo, LessThanOrEqual)):
                self.last = min(self.last, f.value)
            if isinstance(f, GreaterThan):
                self.first = max(self.first, f.value + timedelta(1))
            if isinstance(f, LessThan):
                self.last = min(self.last, f.value - timedelta(1))
            return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
        if values is None or column not in (("keyword",), ("sub_rubric",)):
            return False
        name = "keywords" if column == ("keyword",) else "rubrics"
        had = getattr(self, name)
        setattr(self, name, values if had is None else had & values)
        return True


def listed(spark: SparkSession, path: str, first: str, last: str, queries: tuple = QUERIES, rubrics: tuple = SUB_RUBRICS) -> tuple[DataFrame, DataFrame]:
    """(each entry of the window once, by its first keyword; what each query found) of a landed listing.

    A keyword counts the entries in its own language; those in another one are left out.
    """
    spark.dataSource.register(ListingSource)
    keys = spark.createDataFrame(list(queries), "keyword string, language string")
    window = {"keywords": [k for k, _ in queries], "rubrics": list(rubrics), "first": str(first), "last": str(last)}
    rows = spark.read.format("tidemark_listing").option("window", json.dumps(window)).load(path)
    rows = rows.where(F.col("keyword").isin(*[k for k, _ in queries]) & F.col("sub_rubric").isin(*rubrics) & F.col("published_at").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    mine = F.array_contains(F.array(*[F.lit(f"{k}\x01{x}") for k, x in queries]), F.concat_ws("\x01", "keyword", "language"))
    rows = rows.where(mine)
    return ingest.first_of_each(rows, "id", "keyword"), ingest.by_query(rows, keys)
