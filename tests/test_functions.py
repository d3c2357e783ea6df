import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, domain, stats, text
from tidemark.operators import sampling

D = dt.date


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def day(s):
    return F.lit(s).cast("date")


def test_dates(spark):
    r = one(
        spark, iso=dates.is_iso_date(F.lit("2026-09-01")), short=dates.is_iso_date(F.lit("2026-9-1")), never=dates.is_iso_date(F.lit("2026-02-30")), monday=dates.iso_weekday(day("2024-01-01")),
        start=dates.week_start(day("2024-01-20")), end=dates.week_end(day("2024-01-18"), day("2024-01-20")), leap=dates.whole_years(day("2024-02-29"), day("2026-02-28")),
        bucket=dates.age_bucket(day("2020-01-01"), day("2025-12-31")), unknown=dates.age_bucket(day("2025-01-01"), day("2024-12-31")), local=dates.zurich_day(F.lit("2026-10-04 22:30:00").cast("timestamp")),
    )
    assert (r.iso, r.short, r.never, r.monday) == (True, False, False, 0)
    assert (r.start, r.end, r.leap, r.bucket, r.unknown, r.local) == (D(2024, 1, 15), D(2024, 1, 20), 1, "2_to_6", "unknown", D(2026, 10, 5))


@pytest.mark.parametrize("year, day", [(2019, D(2019, 4, 21)), (2024, D(2024, 3, 31)), (2025, D(2025, 4, 20)), (2038, D(2038, 4, 25)), (1981, D(1981, 4, 19)), (1954, D(1954, 4, 18)), (2000, D(2000, 4, 23))])
def test_easter(spark, year, day):
    assert spark.range(1).select(dates.easter(F.lit(year)).alias("d")).first().d == day


@pytest.mark.parametrize("prose, want", [("vom 29.09.2026 an", D(2026, 9, 29)), ("le 17 décembre 2019", D(2019, 12, 17)), ("1er juin 2026, 02.07.2026", D(2026, 6, 1)), ("31.02.2024", None), ("nie", None), ("3. März 2021", D(2021, 3, 3)), ("5 Quatsch 2021", None)])
def test_swiss_day(spark, prose, want):
    assert one(spark, d=dates.swiss_day(F.lit(prose))).d == want


def test_missing_days(spark):
    present = spark.createDataFrame([("2024-03-28",), ("2024-04-02",)], "d string").select(F.col("d").cast("date").alias("day"))
    assert [r.day for r in dates.missing_days(present, "2024-03-28", "2024-04-03").orderBy("day").collect()] == [D(2024, 4, 3)]
    assert len(dates.missing_days(present, "2024-03-28", "2024-04-03", with_holidays=False).collect()) == 3


def test_text(spark):
    amount, cur = text.stated_amount(F.lit("Acme raises CHF 4.5 million"))
    after, _ = text.stated_amount(F.lit("2bn USD for Acme"))
    r = one(
        spark, uid=text.uid(F.lit(" che-123.456.789")), bad=text.uid(F.lit("CHE-12")), shown=text.display_uid(F.lit("CHE123456789")), name=text.normal_name(F.lit("Müller & Söhne  AG")), stem=text.name_stem(F.lit("Müller AG")),
        has=text.contains_words(F.lit("the acme group"), F.lit("acme")), part=text.contains_words(F.lit("the acmes"), F.lit("acme")), amount=amount, cur=cur, after=after, clip=text.clip(F.lit("one two three"), 9),
        num=text.plain_number(F.lit("1’000,50")), whole=text.plain_number(F.lit("100.00")), shown_amount=text.display_amount(F.lit("1234567.50").cast("decimal(20,2)")), compact=text.compact(F.lit(1_240_000)), k=text.compact(F.lit(120_000)),
        url=text.https_only(F.lit("http://a.ch")), entities=text.decode_entities(F.lit("a &amp;lt; b")), first=text.first_sentence(F.lit("Ein Satz. Und noch einer.")),
    )
    assert (r.uid, r.bad, r.shown) == ("CHE123456789", None, "CHE-123.456.789")
    assert (r.name, r.stem, r.has, r.part) == ("muller and sohne ag", "muller", True, False)
    assert (r.amount, r.cur, r.after, r.clip) == (4_500_000, "CHF", 2_000_000_000, "one two …")
    assert (r.num, r.whole, r.shown_amount, r.compact, r.k) == ("1000.5", "100", "1’234’567.50", "1.2M", "120k")
    assert (r.url, r.entities, r.first) == (None, "a &lt; b", "Ein Satz.")


def test_wilson(spark):
    rows = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (16, 30)], "k long, n long")
    low, high = stats.wilson(F.col("k"), F.col("n"))
    got = [(round(r.low, 3), round(r.high, 3)) for r in rows.select(low.alias("low"), high.alias("high")).collect()]
    assert got == [(0.0, 1.0), (0.0, 0.278), (0.722, 1.0), (0.361, 0.698)]


def test_threshold_ties_go_up(spark):
    items = spark.createDataFrame([(1.0, True, True), (2.0, True, True), (0.5, False, True), (3.0, True, False)], "score double, positive boolean, candidate boolean")
    r = stats.fit_threshold(items).first()
    assert (r.threshold, r.tp, r.fp, r.fn) == (1.0, 2, 0, 1)


def test_allocation(spark):
    r = stats.allocation(spark, 498, 414, 19).first()
    assert (r.b, r.r, r.m) == (16, 13, 1)


def test_rules_ignore_unknown(spark):
    c = {"young_company": F.lit(None).cast("boolean"), "new_preferred_class": F.lit(True), "set_off_only": F.lit(True)}
    r = one(spark, hits=domain.hits(c), score=domain.score(c))
    assert (r.hits, r.score) == (["new_preferred_class", "set_off_only"], 0.0)


def test_tiers_and_status(spark):
    r = one(spark, a=domain.tier(F.lit(0.6)), b=domain.tier(F.lit(0.35)), c=domain.tier(F.lit(0.1)), d=domain.tier(F.lit(None).cast("double")), missed=domain.status(F.lit("abstain"), F.lit(True), F.lit(True)), none=domain.status(F.lit(None).cast("string"), F.lit(False), F.lit(False)))
    assert tuple(r) == ("likely_financing", "abstain", "capital_increased", "abstain", "confirmed_missed", "not_assessed")


def test_seeded_draws_repeat():
    assert sampling.shuffled(range(20), 7) == sampling.shuffled(range(20), 7) != list(range(20))
    draw = sampling.generator(1)
    assert all(0 <= draw() < 1 for _ in range(100))
