import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import asof, history, releases, scoring, sinks
from tidemark.plans import feed
from tidemark.sources import files, gazette
from tidemark.streaming import incremental

D = dt.date
SF = "/root/testdata/sf0.001"


def test_as_of_join_is_inclusive_and_ties_go_to_the_later_row(spark):
    facts = spark.createDataFrame([(1, D(2024, 1, 5)), (1, D(2023, 1, 1)), (2, D(2024, 1, 1))], "k int, at date")
    names = spark.createDataFrame([(1, D(2024, 1, 5), 1, "a"), (1, D(2024, 1, 5), 2, "b"), (1, D(2024, 1, 6), 3, "c")], "k int, since date, id int, name string")
    got = {(r.k, r["at"]): r.name for r in asof.as_of_join(facts, names, "k", "at", "since", "name", "id").collect()}
    assert got == {(1, D(2024, 1, 5)): "b", (1, D(2023, 1, 1)): None, (2, D(2024, 1, 1)): None}


def test_no_output_is_later_than_the_day(spark):
    for day in ("2024-01-10", "2024-01-20"):
        assert feed.feed_rows(spark, SF, day).agg(F.max("published_at").alias("d")).first().d <= D.fromisoformat(day)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 28), st.sampled_from("spc"), st.integers(1, 9)), min_size=1, max_size=8))
def test_fold_sees_no_future(spark, rows):
    def run(rs):
        df = spark.createDataFrame([(1, D(2024, 1, d), i, t, v) for i, (d, t, v) in enumerate(rs)], "u int, at date, id int, t string, v int")
        out = history.fold(df, "u", ["at", "id"], F.when(F.col("t") == "p", F.col("v")), F.when(F.col("t") == "c", F.col("v") < 5), F.col("t") == "c", F.col("t") == "s", "at")
        return {r.id: (r.prev_amount, r.in_force, r.converted, r.founded) for r in out.collect()}

    past = run(rows)
    later = run([*rows, (28, "p", 99)])
    assert {k: later[k] for k in past} == past


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id int, x string")
    sinks.insert_absent(df, path, "id")
    sinks.insert_absent(df.unionByName(spark.createDataFrame([(3, "c")], "id int, x string")), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    old, new = spark.createDataFrame([(1, 1, "a")], "id int, at int, x string"), spark.createDataFrame([(1, 2, "b"), (2, 1, "c")], "id int, at int, x string")
    assert {(r.id, r.x) for r in sinks.upserted(old, new, "id", "at").collect()} == {(1, "b"), (2, "c")}
    marks = sinks.marked(spark.createDataFrame([("a", "failed", 1)], "item string, status string, attempts int"), spark.createDataFrame([("a", "done"), ("b", "failed")], "item string, status string"))
    assert {tuple(r) for r in marks.collect()} == {("a", "done", 2), ("b", "failed", 1)}
    assert [r.item for r in sinks.todo(spark.createDataFrame([("a",), ("b",)], "item string"), marks).collect()] == ["b"]


def test_release_store(spark, tmp_path):
    store = releases.Store(spark, str(tmp_path / "store"))
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    assert store.current() is None
    assert store.write("r1", {"events": one}, [])
    failed = releases.gates({"parse_failures": 10, "publications": 100}, missing_days=0, span_violations=0, has_eval=True)
    assert failed == ["parse_failures"]
    assert not store.write("r2", {"events": two}, failed)
    assert store.current() == "r1" and [r.x for r in store.read("events").collect()] == [1]
    assert store.write("r3", {"events": two}, []) and [r.x for r in store.read("events").collect()] == [2]
    store.activate("r1")
    assert [r.x for r in store.read("events").collect()] == [1]
    try:
        store.activate("r2")
        raise AssertionError
    except ValueError:
        pass


def test_two_writers_take_two_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = releases.CommitLog(spark, str(tmp_path / "log"), "who int")
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda k: log.take(1, {"who": k}), range(8)))
        numbers = list(pool.map(lambda k: log.append({"who": k}), range(24)))
    assert sum(taken) == 1 and sorted(numbers) == list(range(2, 26))
    (tmp_path / "log" / "0000000099.json").write_text('{"who": 7')  # a lost writer's
    assert sorted(r.at for r in log.entries().collect()) == list(range(1, 26)) and log.append({"who": 1}) == 100


def test_prune_drops_partitions_and_goes_on_where_it_died(spark, tmp_path, monkeypatch):
    store = releases.Store(spark, str(tmp_path / "s"))
    row = spark.createDataFrame([(1,)], "x int")
    for k in range(1, 5):
        assert store.write(f"r{k}", {"events": row, "assessments": row}, [])
    store.write("r5", {"events": row, "assessments": row}, ["missing_days"])
    assert {r.id: r.note for r in store.headers().collect()}["r5"] == "missing_days"
    marks = releases.Store.mark
    monkeypatch.setattr(releases.Store, "mark", lambda self, release, status, *a: marks(self, release, status, *a) if status != "pruned" else 1 / 0)
    try:
        store.prune(2)
        raise AssertionError
    except ZeroDivisionError:
        monkeypatch.undo()
    left = lambda t: sorted(r.release_id for r in spark.read.parquet(f"{store.path}/{t}").select("release_id").distinct().collect())
    assert left("events") == left("assessments") == ["r3", "r4"]
    assert store.prune(2) == ["r1", "r2", "r5"] and store.prune(2) == []
    assert {r.id: r.status for r in store.headers().collect()} == {"r1": "pruned", "r2": "pruned", "r3": "ready", "r4": "ready", "r5": "pruned"}
    try:
        store.activate("r1")
        raise AssertionError
    except ValueError:
        pass


XML = """<hr:publication xmlns:hr="http://x"><meta><id>{id}</id><rubric>HR</rubric><subRubric>{sub}</subRubric><language>de</language><publicationNumber>HR02-1</publicationNumber><publicationDate>2026-09-29T00:00</publicationDate><cantons>ZH</cantons></meta>
<content><journalDate>2026-09-24</journalDate><publicationText>{text}</publicationText><commonsNew><company><name>Neu AG</name><uid>CHE-123.456.789</uid><legalForm>{form}</legalForm></company><capital><nominal>{after}</nominal></capital></commonsNew>
<commonsActual><company><name>{old}</name><legalForm>{form0}</legalForm></company><capital><nominal>{before}</nominal></capital></commonsActual></content></hr:publication>"""


def gazette_events(spark, **k):
    k = {"id": "a", "sub": "HR02", "text": "", "form": "0106", "form0": "0106", "after": "100000.00", "before": "100000.00", "old": "Neu AG"} | k
    good, bad = gazette.split(gazette.publications(spark.createDataFrame([(XML.format(**k),)], "xml string")))
    return gazette.events(good).orderBy("seq").collect(), bad.count()


def test_gazette_increase(spark):
    (e,), _ = gazette_events(spark, after="120000.00", text="Statutenänderung: Statuten vom 20.09.2026. Sacheinlage von Waren. Aktien neu: 120 Namenaktien zu CHF 1000.00 [bisher: 100 Namenaktien zu CHF 1000.00].")
    assert (e.type, e.direction, e.contribution, e.capital_after, e.shares_before, e.shares_after) == ("capital_change", "increase", "in_kind", "120000", 100, 120)
    assert (e.uid, e.canton, e.legal_at) == ("CHE123456789", "ZH", D(2026, 9, 20))


def test_gazette_conversion_in_order(spark):
    e, _ = gazette_events(spark, form0="0107", old="Alt GmbH", after="100000.00", before="20000.00", text="Umwandlung der Gesellschaft.")
    assert [x.type for x in e] == ["conversion_to_ag", "capital_change", "name_change"] and e[1].contribution == "cash"


def test_gazette_former_text_is_not_read(spark):
    (e,), _ = gazette_events(spark, after="120000", text="Erhöhung in bar. [gestrichen: Sacheinlage]")
    assert e.contribution == "cash"


def test_gazette_quarantine_and_band(spark):
    e, bad = gazette_events(spark, id="")
    assert (e, bad) == ([], 1)
    (e,), _ = gazette_events(spark, text="Kapitalband eingeführt.")
    assert (e.type, e.band_action) == ("capital_band", "adopted")
    (e,), _ = gazette_events(spark, sub="HR01", text="Neueintragung.")
    assert e.type == "formation"


def test_clauses_stay_inside_the_text(spark):
    raw = spark.createDataFrame([(XML.format(id="a", sub="HR02", text="Statuten neu: 1.2.2026. Zweck: Handel. Aktien neu: Nr. 5 alt.", form="0106", form0="0106", after="1", before="1", old="x"),)], "xml string")
    p = gazette.publications(raw)
    body = p.first().text
    rows = gazette.clauses(p).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["statutes", "purpose", "shares"]
    assert all(body[r.start : r.end] == r.clause for r in rows)


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("", "line\nbreak")], "p string, q string")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "a.json").write_text(json.dumps({"http://u": {"date": "2024-01-01", "title": "t", "companies": ["x", "x", "y"]}}))
    assert {r.company for r in files.articles(spark, str(tmp_path / "a.json")).collect()} == {"x", "y"}
    (tmp_path / "names").write_text("# no\n\n Anna \n")
    assert [r.name for r in files.name_list(spark, str(tmp_path / "names")).collect()] == ["Anna"]


def test_paged_source_is_complete_or_fails(spark, tmp_path):
    item = lambda k: {"id": str(k), "language": "de", "published_at": "2024-01-01"}
    for n, ks in ((0, (0, 1)), (1, (2,))):
        (tmp_path / f"{n}.json").write_text(json.dumps({"total": 3, "items": [item(k) for k in ks]}))
    spark.dataSource.register(files.PagedSource)
    pages = lambda: spark.read.format("tidemark_pages").option("path", str(tmp_path)).option("size", "2").load()
    assert pages().count() == 3
    (tmp_path / "1.json").write_text(json.dumps({"total": 3, "items": []}))
    try:
        pages().count()
        raise AssertionError("it was silent")
    except Exception as e:
        assert "page 1 has 0 of 1 items" in str(e)


def test_scorer_cache_and_failures(spark):
    def scorer(text, fired):
        if text == "refuse":
            return None, []
        if text == "bad":
            raise ValueError("no json")
        return 0.7, ["other"] if text == "cites" else fired

    inputs = spark.createDataFrame([("h1", "fine", ["r"]), ("h2", "refuse", ["r"]), ("h3", "bad", ["r"]), ("h4", "cites", ["r"]), ("h5", "cached", ["r"]), ("h1", "fine", ["r"])], "input_hash string, text string, fired array<string>")
    cache = spark.createDataFrame([("h5", "m", "p", 0.5, [], None)], scoring.RESULT)
    got = {r.input_hash: (r.score, r.error) for r in scoring.score_missing(inputs, cache, scorer, "m", "p").collect()}
    assert got == {"h1": (0.7, None), "h2": (None, "refusal"), "h3": (None, "malformed: no json"), "h4": (None, "cited a rule that did not fire")}
    assert scoring.score_missing(inputs, cache, scorer, "m", "p", cap=2).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(src)
    stream = lambda: incremental.events_stream(spark, src, events.schema)
    for _ in range(2):
        incremental.append_new(stream(), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == events.select("event_id").distinct().count()
    q = incremental.weekly_counts(stream(), "60 days").writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.date_trunc("week", "ts").cast("date").alias("week"), F.col("event_type").alias("type")).count()
    assert {tuple(r) for r in spark.table("weeks").collect()} == {tuple(r) for r in batch.collect()}
