"""The windowed listing: pushed filters, whole ranges, queries and their counts."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.sources import listing

D = datetime.date


def land(root, keyword, days, items, size=2):
    folder = root / keyword / days
    folder.mkdir(parents=True)
    for n in range(max(1, -(-len(items) // size))):
        (folder / f"{n}.json").write_text(json.dumps({"total": len(items), "items": items[n * size : (n + 1) * size]}))


def item(n, day, language="de", rubric="HR02"):
    return {"id": f"p{n}", "language": language, "subRubric": rubric, "publicationDate": f"{day}T00:00", "title": f"t{n}"}


@pytest.fixture
def landed(tmp_path):
    land(tmp_path, "Aktienkapital", "2024-01-01_2024-01-31", [item(k, f"2024-01-{k + 1:02d}") for k in range(5)] + [item(90, "2024-01-09", "fr"), item(91, "2024-01-09", rubric="HR01")])
    land(tmp_path, "Aktienkapital", "2024-02-01_2024-03-02", [item(10, "2024-02-01"), item(11, "2024-02-20")])
    land(tmp_path, "Kapitalband", "2024-01-01_2024-01-31", [item(2, "2024-01-03"), item(20, "2024-01-04")])
    land(tmp_path, "capital-actions", "2024-01-01_2024-01-31", [])
    land(tmp_path, "something else", "2024-01-01_2024-01-31", [item(99, "2024-01-04")])
    return tmp_path


def test_window_queries_and_counts(spark, landed):
    rows, found = listing.listed(spark, str(landed), "2024-01-02", "2024-02-01")
    assert sorted((r.id, r.keyword) for r in rows.collect()) == [("p1", "Aktienkapital"), ("p10", "Aktienkapital"), ("p2", "Aktienkapital"), ("p20", "Kapitalband"), ("p3", "Aktienkapital"), ("p4", "Aktienkapital")]
    assert {(r.keyword, r.n) for r in found.where("n > 0 or keyword = 'capital-actions'").collect()} == {("Aktienkapital", 5), ("Kapitalband", 2), ("capital-actions", 0)}
    assert found.count() == 6


def test_filters_are_pushed_and_prune_pages(spark, landed):
    spark.dataSource.register(listing.ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    every = spark.read.format("tidemark_listing").load(str(landed))
    some = every.where((F.col("keyword") == "Aktienkapital") & (F.col("published_at") >= F.lit("2024-02-10").cast("date")) & F.col("sub_rubric").isin("HR02", "HR03"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # all of it went into the source
    assert some.rdd.getNumPartitions() == 1 and every.rdd.getNumPartitions() > 5
    assert [tuple(r) for r in some.collect()] == [("Aktienkapital", "p11", "de", "HR02", D(2024, 2, 20), "t11")]
    # broken pages outside of what is asked for are not read
    (landed / "Kapitalband" / "2024-01-01_2024-01-31" / "0.json").write_text("{")
    assert some.count() == 1


def test_short_ranges_fail(spark, landed):
    (landed / "Aktienkapital" / "2024-01-01_2024-01-31" / "3.json").unlink()
    with pytest.raises(PySparkException, match="has 3 pages of 4"):
        listing.listed(spark, str(landed), "2024-01-02", "2024-02-01")[0].count()
    page = landed / "Aktienkapital" / "2024-02-01_2024-03-02" / "0.json"
    told = json.loads(page.read_text())
    page.write_text(json.dumps(told | {"total": 3}))
    with pytest.raises(PySparkException, match="pages of"):
        listing.listed(spark, str(landed), "2024-02-01", "2024-02-20")[0].count()


@pytest.mark.parametrize("pushed", ["true", "false"])
def test_one_listing_used_in_several_ways(spark, landed, pushed):
    """Spark keeps one set of pushed filters for each load, and all scans of the load get the last one."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", pushed)
    rows, found = listing.listed(spark, str(landed), "2024-01-02", "2024-02-01")
    of = lambda k: found.where(F.col("keyword") == k).select("keyword", "n")
    assert sorted(map(tuple, of("Kapitalband").unionByName(of("Aktienkapital")).collect())) == [("Aktienkapital", 5), ("Kapitalband", 2)]
    both = of("Kapitalband").crossJoin(rows.agg(F.count("*").alias("all"))).collect()
    assert [tuple(r) for r in both] == [("Kapitalband", 2, 6)]
    # folders outside of the window are not read
    (landed / "something else" / "2024-01-01_2024-01-31" / "0.json").write_text("{")
    (landed / "Aktienkapital" / "2024-02-01_2024-03-02" / "0.json").write_text("{")
    assert listing.listed(spark, str(landed), "2024-01-02", "2024-01-20")[0].count() == 5
