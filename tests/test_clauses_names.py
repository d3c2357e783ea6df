"""Clauses with their places, listed names by automaton, and the gate before publication."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clauses, redaction
from tidemark.operators import names, releases
from tidemark.sources import files, gazette

SF = "/root/testdata/sf0.001"


def cut(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", clauses.clauses(F.col("t")).alias("c")).orderBy("k").collect()
    return [None if r.c is None else [(x.kind, x.text, x.start, x.end) for x in r.c] for r in rows]


def test_clauses_and_their_kinds(spark):
    texts = [
        "Quarz AG, in Olten, CHE-111.222.333, Publ. 1001. Statuten neu: 4. Mai. Aktienkapital: CHF 7.50. von Arx bleibt. Vermerk vom 3. Mai.  ",
        "Rectification de l'entrée no. 7. Quarz SA, CHE-111.222.333. Nouvelles actions: 5. [avant: 4.] Zweck: Bau.",
        "Dr. med. Ott, Präsident. Umwandlung der GmbH.", "Kapitalband: bis 2030. Sacheinlage. Scopo invariato.",
    ]
    got = cut(spark, texts)
    assert [k for k, *_ in got[0]] == ["header", "statutes", "other", "capital", "other", "other", "other"]
    assert [k for k, *_ in got[1]] == ["correction", "header", "shares", "other"]
    assert [k for k, *_ in got[2]] == ["person", "conversion"]
    assert [k for k, *_ in got[3]] == ["band", "contribution", "purpose"]
    for text, parts in zip(texts, got, strict=True):
        assert all(text[a:b] == said for _, said, a, b in parts)


def test_odd_texts_have_clauses_too(spark):
    assert cut(spark, ["", None, " \n ", "x", "\xa0A. B\x01c. D", "...", "A." * 2000])[:6] == [[], None, [], [("other", "x", 0, 1)], [("other", "\xa0A.", 0, 3), ("other", "B c.", 4, 8), ("other", "D", 9, 10)], [("other", "...", 0, 3)]]


def test_clauses_cut_the_documents(spark):
    """Every clause is where it is said to be, and only white space lies between clauses."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null").select("text", clauses.clauses(F.col("text")).alias("c")).collect()
    assert sum(len(r.c) for r in docs) > 3000
    for r in docs:
        at = 0
        for x in r.c:
            assert r.text[x.start : x.end] == x.text and not r.text[at : x.start].strip()
            at = x.end
        assert not r.text[at:].strip()


def test_gate_withholds_what_masks_leave(spark):
    bodies = ["Aktienkapital: Quandt, Ada, von Zug.", "Aktienkapital; soci Ada Quandt.", "Kapital neu. Eingetragene Personen: keine.", "Aktienkapital, c/o Ada Quandt.", "Aktienkapital neu: siehe www.example.org.", "Aktienkapital neu: CHF 5."]
    df = spark.createDataFrame([(t,) for t in bodies], "t string").withColumn("c", F.array(F.struct(F.lit("capital").alias("kind"), F.lit(0).alias("start"), F.length("t").alias("end"))))
    got = [r[0] for r in df.select(redaction.excerpt(F.col("t"), F.col("c"))).collect()]
    assert got == [None, None, None, "Aktienkapital, c/o [name removed].", "Aktienkapital neu: siehe www.example.org.", "Aktienkapital neu: CHF 5."]


@pytest.mark.parametrize(
    "said, kind",
    [
        ("Streichung der Sacheinlage vom Vorjahr. Erhöhung.", "cash"), ("Die Forderungen der Gläubiger wurden verrechnet.", "set_off"), ("Forderung von 5 zur Verrechnung mit dem Verlust.", "cash"), ("Soppressione della clausola. Conferimento in natura.", "in_kind"),
        ("Nachträgliche Liberierung durch Sacheinlage. Ausgabe.", "cash"), ("Aus bedingtem Kapital ausgegeben.", "conditional_capital"), ("Ausgabe aus bedingtem Kapital beschlossen.", "cash"),
    ],
)
def test_contributions_of_removed_and_set_off_clauses(spark, said, kind):
    df = spark.createDataFrame([(said,)], "t string")
    assert df.select(gazette.contribution(gazette.active(F.col("t")))).first()[0] == kind


# names ----------------------------------------------------------------------------------------------------


def plain_places(text, name):
    """(start, end) of a name as words, from a pattern of its own."""
    strip = lambda s: "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    spelled = {name, strip(name.translate(names.DIGRAPHS)), strip(name)}
    return {m.span(1) for s in spelled for m in re.finditer(r"(?<![^\W_])(?=(" + r"\s+".join(map(re.escape, s.split())) + r")(?![^\W_]))", text, re.I)}


def test_ten_thousand_names_over_the_documents(spark):
    """Every place of every name of a long list, in several shards, as a search for each name finds them."""
    rng = random.Random(4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 60 and text is not null").collect()}
    words = sorted({w for t in texts.values() for w in re.findall(r"[^\W\d_]{3,}", t)})
    chosen = [f"{rng.choice(words)} {rng.choice(words)}" for _ in range(9_900)]
    for t in rng.choices(sorted(texts.values()), k=100):
        run = re.findall(r"[^\W\d_]+ [^\W\d_]+", t)
        chosen.append(rng.choice(run) if run else "no such name")
    listed = spark.createDataFrame([(k, n) for k, n in enumerate(chosen)], "n long, name string")
    cells = names.cells(docs.where(F.col("doc_id").isin(*texts)), "doc_id")
    got = {(r.doc_id, r.n, r.start, r.end) for r in names.occurrences(cells, listed, how=names.Listing(shard=4_000)).where("kind = 'words'").collect()}
    assert len(got) > 100
    for n in {g[1] for g in got} | set(range(0, 10_000, 97)):
        for k, t in texts.items():
            assert {(a, b) for d, m, a, b in got if d == k and m == n} == plain_places(t, chosen[n]), chosen[n]


@pytest.mark.parametrize("shard", [1, 2, 100])
def test_scrubbing(spark, shard):
    listed = spark.createDataFrame([(1, "Ada Quör"), (2, "Ada Quör-Lys"), (3, "Éva Noß"), (4, " "), (5, None)], "n long, name string")
    said = [
        ("Ada Quoer-Lys, ADA  QUOR und Eva\xa0Noss", "<PERSON_2>, <PERSON_1> und <PERSON_3>"), ("/x/ada-quoer-lys-7 /ada-quor.html Ada-Quör", "/x/person-2-7 /person-1.html Ada-Quör"), ("Nada Quör, Ada Quörs, Ada Quör2", "Nada Quör, Ada Quörs, Ada Quör2"), ("", ""), (None, None),
    ]
    df = spark.createDataFrame([(k, s, "Ada Quör") for k, (s, _) in enumerate(said)], "k int, text string, other string")
    how = names.Listing(shard=shard)
    got = {r.k: (r.text, r.other) for r in names.scrub(df, "text", listed, how).collect()}
    assert got == {k: (t, "Ada Quör") for k, (_, t) in enumerate(said)}
    done = names.scrub(df, "text", listed, how).select("k", F.col("text").alias("value"))
    names.assert_none_listed("texts", done, listed, how)
    with pytest.raises(ValueError, match="still names"):
        names.assert_none_listed("texts", df.select("k", F.col("other").alias("value")), listed, how)


def test_lists_and_cells_may_be_empty(spark):
    none = spark.createDataFrame([], "n long, name string")
    df = spark.createDataFrame([(1, "x", None)], "k int, a string, b int")
    assert names.cells(df, "k").collect() == [(1, "a", "x")]
    assert names.occurrences(names.cells(df, "k"), none).collect() == [] and names.scrub(df, "a", none).collect() == df.collect()


def test_export_gate_covers_every_cell(spark, tmp_path):
    listed = spark.createDataFrame([(1, "Quandt"), (2, "Li")], "n long, name string")
    rows = spark.createDataFrame([("Li und QUANDTS Erben", "x", 3), ("Li", "y", 4)], "name string, note string, n int")
    assert [tuple(r)[1:] for r in releases.personal_cells(rows, names=listed).collect()] == [("name", "listed person name")]
    assert releases.export(rows, str(tmp_path / "a"), names=listed) == 1 and not (tmp_path / "a").exists()
    assert releases.export(rows, str(tmp_path / "a"), names=listed, skip=("name",)) == 0 and files.read_csv(spark, str(tmp_path / "a")).count() == 2
    doctors = spark.createDataFrame([("Dr. Quandt", None, 1)], "name string, note string, n int")
    assert releases.export(doctors, str(tmp_path / "b")) == 1
