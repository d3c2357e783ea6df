"""A release from gazette XML: events, names, assessments and counters; canonical JSON."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical
from tidemark.operators import derivation, releases
from tidemark.sources import gazette

D = datetime.date
DOC = """<n:publication xmlns:n="http://x"><meta><id>{id}</id><rubric>HR</rubric><subRubric>{sub}</subRubric><language>de</language><publicationNumber>{number}</publicationNumber><publicationDate>{day}</publicationDate><cantons>SO</cantons></meta>
<content><journalDate>{day}</journalDate><publicationText>{text}</publicationText><commonsNew><company><name>{name}</name><uid>{uid}</uid><seat>Olten</seat><legalForm>{form}</legalForm></company><purpose>{purpose}</purpose><capital><nominal>{after}</nominal></capital></commonsNew>
<commonsActual><company><name>{old}</name><legalForm>{form}</legalForm></company><capital><nominal>{before}</nominal></capital></commonsActual></content></n:publication>"""
ANSWERS = "input_hash string, model string, prompt string, score double, error string"


def doc(n, day, uid="CHE-111.111.111", **k):
    k = {"sub": "HR02", "text": "Eintrag.", "form": "0106", "after": "100000", "before": "100000", "name": "Quarz AG", "old": "Quarz AG", "purpose": "Handel mit Waren."} | k
    return DOC.format(id=f"p{n}", number=f"HR02-{n:04d}", day=day, uid=uid, **k)


def shares(now, before=None, nominal="1.00"):
    return f"Aktien neu: {now} Namenaktien zu CHF {nominal}" + (f" [bisher: {before} Namenaktien zu CHF {nominal}]." if before else ".")


HISTORY = [
    doc(1, "2024-01-03", sub="HR01", name="Quarz Labs AG", old="Quarz Labs AG", text="Statuten neu: 02.01.2024. Neueintragung."),
    doc(2, "2024-02-05", after="120500.50", before="100000", text=shares("120500", "100000") + " Kapitalerhöhung in bar.", purpose="Entwicklung von Software."),
    doc(3, "2024-02-06", text="Kapitalband eingeführt.", old="Quarz Labs AG"),
    doc(4, "2024-02-07", after="130500.50", before="120500.50", text=shares("130500") + " Sacheinlage von Maschinen."),
    doc(5, "2024-02-08", uid="CHE-222.222.222", form="0107", after="30000", before="20000", text="Kapitalerhöhung.", name="Beryll GmbH", old="Beryll GmbH"),
    doc(6, "2024-02-09", after="90000", before="130500.50", text="Kapitalherabsetzung."),
    doc(7, "2024-03-01", after="500000", before="90000", text="Kapitalerhöhung nach dem Stichtag."),
    doc(8, "kein Tag", text="Unlesbar."),
]
PLAN = derivation.Plan(snapshot="2024-02-12", backfill_start="2024-02-05", model="m", prompt="p")


def frame(spark, docs):
    return spark.createDataFrame([(x,) for x in docs], "xml string").repartition(3)


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), ANSWERS)


@pytest.fixture(scope="module")
def derived(spark, tmp_path_factory):
    parsed = derivation.parse(frame(spark, HISTORY), str(tmp_path_factory.mktemp("d") / "parsed"))
    out = derivation.derive(parsed, PLAN, answers(spark))
    rows = {name: [r.asDict(recursive=True) for r in df.collect()] for name, df in out.rows.items()}
    return rows, out.counters()


def test_events_and_their_context(derived):
    rows, _ = derived
    events = {(e["publication_id"], e["type"]): e for e in rows["events"]}
    assert sorted(events) == [("p1", "formation"), ("p2", "capital_change"), ("p3", "capital_band"), ("p3", "name_change"), ("p4", "capital_change"), ("p5", "capital_change"), ("p6", "capital_change")]
    second, fourth = events["p2", "capital_change"], events["p4", "capital_change"]
    assert (second["shares_before"], second["shares_source"], second["prior_band"], second["age_bucket"]) == (100000, "entry", False, "under_2")
    assert (fourth["shares_before"], fourth["shares_source"], fourth["prior_band"], fourth["contribution"]) == (120500, "previous_event", True, "in_kind")
    assert events["p5", "capital_change"]["age_bucket"] == "unknown" and fourth["new_preferred_class"] is False
    assert second["excerpt"].startswith("Aktien neu: 120500") and all(s["kind"] in derivation.EVIDENCE["capital_change"] for s in second["spans"]) and second["spans"]
    assert (events["p3", "name_change"]["name_before"], events["p3", "name_change"]["name_after"]) == ("Quarz Labs AG", "Quarz AG")


def test_names_and_assessments(derived):
    rows, counters = derived
    assert {(n["publication_id"], n["name"]) for n in rows["names"]} == {("p1", "Quarz Labs AG"), ("p2", "Quarz AG"), ("p3", "Quarz AG"), ("p4", "Quarz AG"), ("p5", "Beryll GmbH"), ("p6", "Quarz AG")}
    by_id = {e["event_id"]: e["publication_id"] for e in rows["events"]}
    told = {by_id[a["event_id"]]: a for a in rows["assessments"]}
    assert sorted(told) == ["p2", "p4", "p5"]  # the reduction has no tier, the last increase is after the snapshot
    assert told["p2"]["rule_hits"] == ["odd_amount_small_nominal", "young_company", "tech_purpose"] and (told["p2"]["rules_score"], told["p2"]["rules_positive"]) == (2.0, True)
    assert told["p4"]["rule_hits"] == ["young_company", "in_kind_only"] and (told["p4"]["tier"], told["p4"]["rules_positive"]) == ("abstain", False)
    assert (told["p5"]["reject_reason"], told["p5"]["tier"], told["p5"]["input_hash"]) == ("not_ag", "capital_increased", None)
    assert counters == {"publications": 8, "parse_failures": 1, "events": 7, "span_violations": 0, "names": 6, "assessments": 3, "candidates": 2, "scorer_errors": 2}


def test_answers_decide_tiers(spark, derived, tmp_path):
    rows, _ = derived
    by_id = {e["event_id"]: e["publication_id"] for e in rows["events"]}
    hashes = {by_id[a["event_id"]]: a["input_hash"] for a in rows["assessments"]}
    parsed = derivation.parse(frame(spark, HISTORY), str(tmp_path / "parsed"))
    told = answers(spark, (hashes["p2"], "m", "p", 0.9, None), (hashes["p4"], "m", "p", None, "refusal"), (hashes["p4"], "other", "p", 0.9, None))
    out = derivation.derive(parsed, PLAN, told)
    tiers = {by_id[r.event_id]: r.tier for r in out.rows["assessments"].collect()}
    assert tiers == {"p2": "likely_financing", "p4": "abstain", "p5": "capital_increased"}
    out.rows["events"].count(), out.rows["names"].count()
    assert out.counters()["scorer_errors"] == 0


def test_founding_from_elsewhere_counts_once_it_is_past(spark, tmp_path):
    parsed = derivation.parse(frame(spark, HISTORY), str(tmp_path / "parsed"))
    known = spark.createDataFrame([("CHE222222222", D(2020, 1, 1)), ("CHE111111111", D(1990, 1, 1))], "uid string, founded_on date")
    ages = {r.publication_id: r.age_bucket for r in derivation.derive(parsed, PLAN, answers(spark), known).rows["events"].where("type = 'capital_change'").collect()}
    assert ages == {"p2": "under_2", "p4": "under_2", "p5": "2_to_6", "p6": "under_2"}


def test_later_documents_change_nothing_before_them(spark, tmp_path):
    some = derivation.parse(frame(spark, HISTORY[:4]), str(tmp_path / "some"))
    every = derivation.parse(frame(spark, HISTORY), str(tmp_path / "every"))
    of = lambda x: {r.event_id: r.asDict(recursive=True) for r in derivation.derive(x, PLAN, answers(spark)).rows["events"].collect()}
    few, all_ = of(some), of(every)
    assert few and all(all_[k] == v for k, v in few.items())


def test_build_writes_gates_and_activates(spark, tmp_path):
    store = releases.Store(spark, str(tmp_path / "store"))
    docs, none = frame(spark, HISTORY[:7]), answers(spark)
    dry = derivation.build(store, "r1", docs, PLAN, none, has_eval=True, dry=True)
    assert not dry.activated and store.headers().isEmpty() and dry.counters["events"] == 7
    first = derivation.build(store, "r1", docs, PLAN, none, has_eval=False)
    assert first.failures == ["scorer_errors", "missing_days", "no_evaluation"] and store.current() is None and first.counters == dry.counters
    hashes = [r.input_hash for r in store.read("assessments", "r1").where("input_hash is not null").collect()]
    days = [doc(100 + k, day, uid="CHE-333.333.333", name="Jade AG", old="Jade AG") for k, day in enumerate(("2024-02-05", "2024-02-06", "2024-02-07", "2024-02-08", "2024-02-09", "2024-02-12"))]
    told = answers(spark, *[(h, "m", "p", 0.7, None) for h in hashes])
    second = derivation.build(store, "r2", frame(spark, HISTORY[:7] + days), PLAN, told, has_eval=True)
    assert second.activated and store.current() == "r2" and second.counters["scorer_errors"] == 0
    assert {r.tier for r in store.read("assessments").collect()} == {"likely_financing", "capital_increased"}
    assert store.read("events").count() == second.counters["events"] and store.read("names").count() == second.counters["names"]


def test_nothing_to_derive(spark, tmp_path):
    out = derivation.derive(derivation.parse(spark.createDataFrame([], "xml string"), str(tmp_path / "p")), PLAN, answers(spark))
    assert all(df.count() == 0 for df in out.rows.values()) and set(out.counters().values()) == {0}


def test_canonical_json(spark):
    texts = ['{"b": 1, "a": {"y": [1, {"q": null, "p": "x\\"y"}], "x": "é\\u00e9\\n"}}', '{"a": {"x": "\\u00e9é\\n", "y": [1, {"p": "x\\"y", "q": null}]}, "b": 1}', '{"a": 1}', "not json", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.json_text(F.col("t"))).collect()]
    assert got[0] == got[1] == json.dumps(json.loads(texts[0]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got[2] == '{"a":1}' and got[3:] == [None, None]
    df = spark.sql("select named_struct('b', 1, 'a', named_struct('d', cast(null as string), 'c', 'ü')) x, named_struct('a', named_struct('c', 'ü', 'd', cast(null as string)), 'b', 1) y")
    r = df.select(canonical.json_value(F.col("x")).alias("j"), canonical.fingerprint(F.col("x")).alias("x"), canonical.fingerprint(F.col("y")).alias("y")).first()
    assert r.j == '{"a":{"c":"ü","d":null},"b":1}' and r.x == r.y


def test_fields_are_the_first_places_of_their_paths(spark):
    odd = """<!DOCTYPE n:p [<!ENTITY firm "Onyx">]><n:p xmlns:n="http://x"><meta><id> p1 </id><id>p2</id><subRubric/><publicationNumber>&#8203;7</publicationNumber></meta><meta><id>p3</id></meta>
<content><publicationText>Sitz <b>Olten</b>: &lt;neu&gt; <![CDATA[& <alt>]]></publicationText><commonsNew><capital><nominal>1'000,50</nominal></capital><company><name>&firm; AG</name></company><purpose>  </purpose></commonsNew></content></n:p>"""
    r = gazette.publications(frame(spark, [odd])).first()
    assert (r.id, r.sub_rubric, r.number, r.text, r.name, r.purpose) == ("p1", None, "\u200b7", "Sitz Olten: <neu> & <alt>", "Onyx AG", None)
    assert (r.capital_after, r.capital_before, r.published_at, r.canton, r.uid, r.flagged) == ("1000.5", None, None, None, None, None)
    none = gazette.publications(spark.createDataFrame([(None,), ("",)], "xml string")).collect()
    assert [(r.id, r.text) for r in none] == [(None, "")] * 2


def test_a_document_is_read_once_for_all_fields(spark):
    plan = gazette.publications(frame(spark, HISTORY))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("xpath") == 1


def test_names_of_a_long_history_are_held_once(spark, tmp_path):
    days = [f"2024-{m:02d}-{d:02d}" for m in (1, 2) for d in range(1, 29)]
    docs = [doc(k, days[k * len(days) // 600], name="Quarz AG" if k < 400 else "Onyx AG", old="Quarz Labs AG" if k == 0 else "Quarz AG") for k in range(600)]
    rows = derivation.folded(derivation.parse(frame(spark, docs), str(tmp_path / "parsed")).parent)
    assert {(int(r.id[1:]) >= 400, *sorted(r.names)) for r in rows.collect() if r.published_at != D(2024, 2, 10)} == {(False, "Quarz AG", "Quarz Labs AG"), (True, "Onyx AG", "Quarz AG", "Quarz Labs AG")}
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(" in plan and "collect_list(" not in plan  # a list would hold a name for each publication before, in each row


def test_documents_of_a_small_file_are_dealt(spark, monkeypatch):
    from tidemark.plans import catalogue

    seen, parse = [], derivation.parse
    monkeypatch.setattr(derivation, "parse", lambda raw, path: (seen.append(raw.rdd.getNumPartitions()), parse(raw, path))[1])
    catalogue.queries()["release_tiers"](spark, "/root/testdata/sf0.001")
    assert seen == [int(spark.conf.get("spark.sql.shuffle.partitions"))]
