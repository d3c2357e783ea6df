"""Calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.plans.catalogue import query
from tidemark.sources import tables

O = "o as (select *, cast(o_orderdate as date) as day from orders)"  # noqa: E741


@query(f"with {O} select o_orderkey, date_trunc('week', day)::date as week_start, least((date_trunc('week', day)::date + 6), date '1998-01-01') as week_end, isodow(day) - 1 as weekday from o")
def week_windows(spark, sf_dir):
    o, day = tables.orders(spark, sf_dir), F.col("day")
    return o.select("o_orderkey", dates.week_start(day).alias("week_start"), dates.week_end(day, F.lit("1998-01-01").cast("date")).alias("week_end"), dates.iso_weekday(day).cast("long").alias("weekday"))


@query(f"with {O} select o_orderkey, day + 180 as later, day - 120 as earlier, date_diff('day', day, date '1998-08-02') as age_days from o")
def date_arith(spark, sf_dir):
    o = tables.orders(spark, sf_dir)
    return o.select("o_orderkey", F.date_add("day", 180).alias("later"), F.date_sub("day", 120).alias("earlier"), F.datediff(F.lit("1998-08-02").cast("date"), "day").cast("long").alias("age_days"))


_EASTER = """e as (select y as year, y % 19 as a, y // 100 as b, y % 100 as c from generate_series(1990, 2049) t(y)),
 e2 as (select year, a, (19*a + b - b//4 - ((b - (b+8)//25 + 1)//3) + 15) % 30 as h, b, c from e), e3 as (select year, a, h, (32 + 2*(b%4) + 2*(c//4) - h - (c%4)) % 7 as l from e2),
 e4 as (select year, h + l - 7*((a + 11*h + 22*l)//451) + 114 as s from e3), easter as (select year, make_date(year, s//31, s%31 + 1) as d from e4)"""


@query(f"with {_EASTER} select year, holiday from (select year, d + k as holiday from easter, (values (-2),(1),(39),(50)) v(k) union all select year, make_date(year, m, dd) from easter, (values (1,1),(1,2),(8,1),(12,25),(12,26)) f(m, dd))")
def holiday_calendar(spark, sf_dir):
    return dates.holidays(spark.range(1990, 2050).select(F.col("id").alias("year"))).select("year", "holiday")


@query(f"with {O}, {_EASTER}, hol as (select d + k as holiday from easter, (values (-2),(1),(39),(50)) v(k) union all select make_date(year, m, dd) from easter, (values (1,1),(1,2),(8,1),(12,25),(12,26)) f(m, dd)) select cast(g as date) as day from generate_series(date '1995-01-01', date '1996-12-31', interval 1 day) t(g) where isodow(g) < 6 and cast(g as date) not in (select holiday from hol) and cast(g as date) not in (select day from o where o_custkey % 10 = 0)")
def missing_days(spark, sf_dir):
    return dates.missing_days(tables.orders(spark, sf_dir).where("o_custkey % 10 = 0"), "1995-01-01", "1996-12-31")


@query(f"""with {O}, f as (select o_custkey, min(day) as founded from o group by 1), y as (select o_orderkey, day, founded, year(day) - year(founded) - case when strftime(day, '%m-%d') < strftime(founded, '%m-%d') then 1 else 0 end as years from o join f using (o_custkey))
 select o_orderkey, cast(years as int) as years, case when years < 2 then 'under_2' when years < 6 then '2_to_6' else 'over_6' end as bucket from y""")
def age_bucket(spark, sf_dir):
    o = tables.orders(spark, sf_dir).select("o_custkey", "o_orderkey", "day")
    both = o.join(o.groupBy("o_custkey").agg(F.min("day").alias("founded")), "o_custkey")
    return both.select("o_orderkey", dates.whole_years(F.col("founded"), F.col("day")).alias("years"), dates.age_bucket(F.col("founded"), F.col("day")).alias("bucket"))


@query("select event_id, cast(timezone('Europe/Zurich', timezone('UTC', ts)) as date) as local_day from events")
def zurich_day(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", dates.zurich_day(F.col("ts").cast("timestamp")).alias("local_day"))


@query(f"""with {O}, r as (select o_orderkey, case when o_orderkey % 4 = 0 then strftime(day, '%Y-%-m-%-d') when o_orderkey % 4 = 1 then null else strftime(day, '%Y-%m-%d') end as raw from o),
 d as (select *, case when regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') then try_cast(raw as date) end as given from r)
 select o_orderkey, coalesce(least(greatest(given, date '1993-01-01'), date '1997-01-01'), date '1997-01-01') as as_of, case when raw is null then null when given is null then 'malformed' when given < date '1993-01-01' then 'before' when given > date '1997-01-01' then 'after' end as notice from d""")
def asof_resolve(spark, sf_dir):
    o = tables.orders(spark, sf_dir)
    raw = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("day", "yyyy-M-d")).when(F.col("o_orderkey") % 4 == 1, None).otherwise(F.date_format("day", "yyyy-MM-dd"))
    told = o.select("o_orderkey", raw.alias("raw"))
    day, notice = dates.resolve_as_of(F.col("raw"), F.lit("1993-01-01").cast("date"), F.lit("1997-01-01").cast("date"))
    return told.select("o_orderkey", day.alias("as_of"), notice.alias("notice"))


_MONTHS = "case month(day) " + " ".join(f"when {k + 1} then '{m[1]}'" for k, m in enumerate(dates.MONTHS)) + " end"


@query(f"with {O} select o_orderkey, day as parsed from o")
def swiss_date_parse(spark, sf_dir):
    """Days written out in three wordings and read back."""
    o, day = tables.orders(spark, sf_dir), F.col("day")
    name = lambda lang: F.get(F.array(*[F.lit(m[lang]) for m in dates.MONTHS]), F.month(day) - 1)
    words = lambda lang: F.concat(F.lit("Statuten vom "), F.day(day).cast("string"), F.when((F.day(day) == 1) & F.lit(lang == 1), "er").otherwise(""), F.lit(" "), name(lang), F.lit(" "), F.year(day).cast("string"), F.lit("."))
    prose = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Tagesregister "), F.date_format(day, "d.M.yyyy"), F.lit(", 1er mai 2001"))).when(F.col("o_orderkey") % 3 == 1, words(1)).otherwise(words(0))
    return o.select("o_orderkey", prose.alias("prose")).select("o_orderkey", dates.swiss_day(F.col("prose")).alias("parsed"))


@query(f"""with {O}, l as (select l_orderkey, min(cast(l_shipdate as date)) as s, max(cast(l_shipdate as date)) as j from lineitem group by 1)
 select o_orderkey, case when d between day - 3650 and day then d else day end as legal_date from (select o_orderkey, day, coalesce(case when o_orderkey % 3 = 0 then s - 60 end, j, day) as d from o left join l on o_orderkey = l_orderkey)""")
def legal_date_check(spark, sf_dir):
    o = tables.orders(spark, sf_dir)
    per = tables.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.min("day").alias("s"), F.max("day").alias("j"))
    both = o.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", dates.legal_day(F.when(F.col("o_orderkey") % 3 == 0, F.date_sub("s", 60)), F.col("j"), F.col("day")).alias("legal_date"))


@query(f"with {O} select o_orderkey, strftime(day, '%-d %b %Y') as shown, case when date_trunc('month', day) = date_trunc('month', day + 6) then strftime(day, '%-d') when year(day) = year(day + 6) then strftime(day, '%-d %b') else strftime(day, '%-d %b %Y') end || ' – ' || strftime(day + 6, '%-d %b %Y') as range from o")
def format_dates(spark, sf_dir):
    day = F.col("day")
    return tables.orders(spark, sf_dir).select("o_orderkey", dates.display(day).alias("shown"), dates.display_range(day, F.date_add(day, 6)).alias("range"))
