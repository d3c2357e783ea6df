"""The pipeline's stages against brute force, on odd tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate string"


def rows():
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfk" for b in "aeiou" for c in ("n", "r", "st")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    texts = {k: prose(60) for k in range(12)}
    texts[12] = texts[3]
    texts[13] = texts[4] + " more"
    texts[14] = texts[5] + "\nmail me@x.example.org or 10.0.0.1"
    texts |= {15: None, 16: "", 17: "too short", 18: "a | b | c | d | e | f |\n" * 9, 19: prose(5000)}
    out = [(k, t, "en", "s", len(t or ""), "x") for k, t in texts.items()]
    return out + [out[2]]


def stage(spark, tmp_path, name, docs):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    path = str(tmp_path / name)
    out.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages(spark, tmp_path):
    spark.createDataFrame([(k, int(k != 18), 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(rows(), SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))  # mixing learns its domains from the raw documents
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near duplicates", "personal data", "mixing", "packing"]
    one = stage(spark, tmp_path, "quality", docs)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {*range(15), 19}
    two = stage(spark, tmp_path, "near duplicates", one)
    assert two.columns == docs.columns and sorted(r.doc_id for r in two.collect()) == [*range(12), 19]
    # one id with unlike texts loses none, rows without an id are judged by their texts, and the smallest id stays wherever it stands
    text = {r.doc_id: r.text for r in docs.collect()}
    odd = spark.createDataFrame([(9, text[1], "en"), (3, text[0], "de"), (3, text[2], "de"), (None, text[2], "x"), (None, text[6], "x"), (None, text[6], "x"), (4, text[1], "x"), (None, None, "x"), (5, "", "x")], "doc_id long, text string, lang string")
    left = stage(spark, tmp_path / "odd", "near duplicates", odd).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in left) == sorted([(3, text[0]), (3, text[2]), (-1, text[6]), (4, text[1]), (-1, ""), (5, "")])
    once = docs.dropDuplicates(["doc_id"])
    assert sorted(r.doc_id for r in stage(spark, tmp_path / "once", "near duplicates", once.where("doc_id < 15")).collect()) == list(range(12))
    three = stage(spark, tmp_path, "personal data", docs.where("doc_id = 14 or doc_id = 15"))
    text = {r.doc_id: (r.text, r.n_chars) for r in three.collect()}
    assert text[14][0].endswith("mail [EMAIL] or [IP]") and text[14][1] == len(text[14][0]) and text[15] == (None, None)
    four = stage(spark, tmp_path, "mixing", two)
    assert four.columns == docs.columns and four.count() > 0
    five = stage(spark, tmp_path, "packing", four)
    assert five.agg(F.sum("length")).first()[0] > 0
    for name, _ in corpus_pipeline.STAGES:
        assert stage(spark, tmp_path, name, docs.limit(0)).count() == 0
