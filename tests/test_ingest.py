"""Landed documents and resumable ingest, with deaths between writes."""

import datetime
import os

import pytest
from pyspark.sql import DataFrameWriter

from tidemark.operators import ingest
from tidemark.streaming import landing

D = datetime.date
GOOD = "<n:p xmlns:n='x'><meta><id>{}</id></meta><content><publicationText>t</publicationText></content></n:p>"


def test_second_run_reads_only_new_files(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "out")
    (source / "sub").mkdir(parents=True)
    (source / "a.xml").write_text(GOOD.format("a"))
    (source / "sub" / "b.xml").write_text("<?xml version='1.0'?>\n" + GOOD.format("b") + "\n")
    (source / "cut.xml").write_text(GOOD.format("c")[:-20])
    (source / "page.xml").write_text("<html><body>not found</body></html>")
    (source / "bad.xml").write_bytes(b"<p>\xff\xfe</p>")
    (source / "empty.xml").write_text(" \n")
    (source / "none.xml").write_text("")  # Spark passes over files of no length
    (source / "note.txt").write_text("no")
    assert landing.take_in(spark, str(source), path) == 6
    docs = lambda: sorted((r.id, os.path.basename(r.file)) for r in landing.documents(spark, path).collect())
    assert docs() == [("a", "a.xml"), ("b", "b.xml")]
    reasons = {os.path.basename(r.file): r.reason for r in spark.read.parquet(f"{path}/quarantine").collect()}
    assert reasons == {"cut.xml": "not a whole document", "page.xml": "not a publication", "bad.xml": "not UTF-8", "empty.xml": "empty"}
    assert landing.take_in(spark, str(source), path) == 0
    (source / "sub" / "c.xml").write_text(GOOD.format("c"))
    (source / "again.xml").write_text(GOOD.format("a"))
    assert landing.take_in(spark, str(source), path) == 2 and docs() == [("a", "a.xml"), ("b", "b.xml"), ("c", "c.xml")]


def test_white_space_around_landed_documents(spark):
    texts = {"lf": GOOD.format("a") + "\n", "crlf": "\r\n" + GOOD.format("b") + "\r\n\t ", "none": GOOD.format("c"), "cut": GOOD.format("d")[:-1] + "\n", "blank": "\t\r\n \n"}
    files = spark.createDataFrame([(k, None, bytearray(v, "utf-8")) for k, v in texts.items()], "path string, modificationTime timestamp, content binary")
    got = {r.file: (r.id, r.xml, r.reason) for r in landing.checked(files).collect()}
    assert {k: (i, reason) for k, (i, _, reason) in got.items()} == {"lf": ("a", None), "crlf": ("b", None), "none": ("c", None), "cut": (None, "not a whole document"), "blank": (None, "empty")}
    assert {k: x for k, (_, x, _) in got.items()} == texts  # kept as they came


SCHEMA = "id string, published_at date, text string"


def world(spark, n=30, missing=()):
    rows = [(f"p{k}", D(2024, 1, 1) + datetime.timedelta(k)) for k in range(n)]
    listing = spark.createDataFrame([*rows, rows[0]], "id string, published_at date")
    return listing, spark.createDataFrame([(i, d, f"text {i}") for i, d in rows if i not in missing], SCHEMA)


def tables(spark, path):
    x = ingest.Ingest(spark, path, SCHEMA)
    attempts = sorted(map(tuple, x.attempts().collect()), key=str)
    return sorted(map(tuple, x.publications().collect())), attempts


def test_window_looks_back_and_counts_new_keys(spark, tmp_path):
    listing, docs = world(spark)
    x = ingest.Ingest(spark, str(tmp_path), SCHEMA)
    assert x.run("a", listing, docs, "2024-01-03", "2024-01-10") == ingest.Taken(8, 8, 8, 0)
    # a week before the newest stored day, January 10: eight days are listed again, five are new
    assert x.run("b", listing, docs, "2024-01-03", "2024-01-15") == ingest.Taken(13, 13, 5, 0)
    assert x.run("b", listing, docs, "2024-01-03", "2024-01-15") == ingest.Taken(13, 0, 0, 0)
    assert ingest.add_new(docs, str(tmp_path / "publications"), "id") == 17 and ingest.add_new(docs, str(tmp_path / "publications"), "id") == 0


def test_failed_items_are_tried_again_up_to_a_limit(spark, tmp_path):
    x = ingest.Ingest(spark, str(tmp_path), SCHEMA)
    listing, docs = world(spark, 5, missing={"p1", "p3"})
    assert x.run("a", listing, docs, "2024-01-01", "2024-01-05") == ingest.Taken(5, 5, 3, 2)
    listing, docs = world(spark, 5, missing={"p3"})
    assert x.run("a", listing, docs, "2024-01-01", "2024-01-05") == ingest.Taken(5, 2, 1, 1)
    assert x.run("a", listing, docs, "2024-01-01", "2024-01-05") == ingest.Taken(5, 1, 0, 1)
    assert x.run("a", listing, docs, "2024-01-01", "2024-01-05") == ingest.Taken(5, 0, 0, 0)
    assert {(r.item, r.status, r.attempts, r.error) for r in x.checkpoints("a").where("attempts > 1").collect()} == {("p1", "done", 2, None), ("p3", "failed", 3, "not fetched")}


@pytest.mark.parametrize("death", [0, 1, 2])
def test_a_run_that_died_and_ran_again_equals_one_clean_run(spark, tmp_path, monkeypatch, death):
    """It dies right before its first, second or third write: the window, the publications, the attempts."""
    listing, docs = world(spark, 12, missing={"p2"})
    clean, broken = str(tmp_path / "clean"), str(tmp_path / "broken")
    for path in (clean, broken):
        ingest.Ingest(spark, path, SCHEMA).run("first", listing, docs, "2024-01-01", "2024-01-04")
    ingest.Ingest(spark, clean, SCHEMA).run("second", listing, docs, "2024-01-01", "2024-01-12")
    plain, seen = DataFrameWriter.parquet, []

    def dying(self, path, *a, **k):
        seen.append(path)
        if len(seen) == death + 1:
            raise RuntimeError("lost")
        return plain(self, path, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(RuntimeError, match="lost"):
        ingest.Ingest(spark, broken, SCHEMA).run("second", listing, docs, "2024-01-01", "2024-01-12")
    monkeypatch.undo()
    ingest.Ingest(spark, broken, SCHEMA).run("second", listing, docs, "2024-01-01", "2024-01-12")
    assert tables(spark, broken) == tables(spark, clean)
