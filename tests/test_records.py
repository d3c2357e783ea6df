from pyspark.sql import functions as F

from tidemark.functions import redaction
from tidemark.operators import releases
from tidemark.sources import files, gazette


def test_label_sheet(spark, tmp_path):
    p = tmp_path / "sheet.md"
    p.write_text("# Title\n\n## A1 · x\n- kind: new\n- reason: a: b \n\n## A12 · y\n- kind:\n- reason: c\n")
    assert [tuple(r) for r in files.sheet(spark, str(p), ["kind", "reason"]).orderBy("n").collect()] == [(1, "new", "a: b"), (12, None, "c")]


def test_export_is_gated(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1), (None, 2)], "name string, n int")
    rules = {"mail": "@", "uid": "CHE-[0-9]"}
    bad = rows.unionByName(spark.createDataFrame([("a@example.org", 3)], "name string, n int"))
    assert releases.export(bad, str(tmp_path / "a"), rules) == 1 and not (tmp_path / "a").exists()
    assert releases.export(rows, str(tmp_path / "b"), rules) == 0 and files.read_csv(spark, str(tmp_path / "b")).count() == 2


def test_same_system(spark):
    df = spark.sql("select named_struct('a', 1, 'b', null) as x, named_struct('a', 1, 'b', null) as y, named_struct('a', 1, 'b', 2) as z, cast(null as struct<a int, b int>) as none")
    of = lambda m, c: releases.same_system(F.col(m), F.col(c), ["a", "b"])
    assert tuple(df.select(of("x", "y"), of("x", "z"), of("none", "y")).first()) == (True, False, False)


def test_redaction_of_odd_texts(spark):
    df = spark.createDataFrame([(None, None), ("", []), ("c/o Ada Quandt und C++ Labs", ["C++ Labs"])], "t string, names array<string>")
    got = df.select(redaction.redacted(F.col("t"), F.col("names"), F.lit(None).cast("string")), redaction.numbered(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, None), ("", ""), ("c/o [person] und [company]", "c/o <PERSON_1> und C++ Labs")]


def test_shares_of_texts_that_state_none(spark):
    df = spark.createDataFrame([(None, "de"), ("Nichts.", "fr"), ("Aktien: 7 Namenaktien zu CHF 1.00.", None)], "t string, l string")
    got = df.select(gazette.share_segments(F.col("t"), F.col("l")).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), ("7 Namenaktien zu CHF 1.00", None)]
