"""Read path: as-of views, the weekly feed, series and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, domain, text
from tidemark.operators import asof, leaks
from tidemark.plans.catalogue import query
from tidemark.sources import tables

AS_OF = "2024-01-20"
#: The events in their roles, for SQL.
EV = """ev as (select event_id, user_id, cast(ts as date) as published_at, event_type as type, cast(value as decimal(18,2)) as amount,
  cast(json_extract_string(props, '$.k') as int) as k from events)"""
VIS = EV + f", vis as (select * from ev where published_at <= date '{AS_OF}'), cancel as (select event_id - 1 - k as event_id, max(published_at) as d from vis where type = 'error' group by 1)"
SCORE = "cast(k as double) / 100"
TIER = f"case when {SCORE} is null then 'abstain' when {SCORE} >= 0.6 then 'likely_financing' when {SCORE} >= 0.35 then 'abstain' else 'capital_increased' end"


def _visible(spark, sf_dir) -> DataFrame:
    return asof.visible(tables.events(spark, sf_dir), AS_OF)


def _cancellations(visible: DataFrame) -> DataFrame:
    return visible.where("type = 'error'").select((F.col("event_id") - 1 - F.col("k")).alias("cancels"), "published_at")


def _score():
    return F.col("k").cast("double") / 100


@query(f"with {VIS} select event_id, user_id, published_at, type from vis")
def asof_visible(spark, sf_dir):
    return _visible(spark, sf_dir).select("event_id", "user_id", "published_at", "type")


@query(f"with {VIS} select v.event_id, v.type, v.published_at from vis v anti join cancel c on v.event_id = c.event_id where v.type <> 'error'")
def asof_cancellation_anti(spark, sf_dir):
    v = _visible(spark, sf_dir)
    return asof.uncancelled(v.where("type <> 'error'"), _cancellations(v), "event_id").select("event_id", "type", "published_at")


@query(f"with {VIS} select v.event_id, c.d as corrected_at from vis v left join cancel c on v.event_id = c.event_id where v.type = 'purchase'")
def correction_latest(spark, sf_dir):
    v = _visible(spark, sf_dir)
    last = _cancellations(v).groupBy(F.col("cancels").alias("event_id")).agg(F.max("published_at").alias("corrected_at"))
    return v.where("type = 'purchase'").join(last, "event_id", "left").select("event_id", "corrected_at")


@query("select o_custkey, arg_max(o_orderpriority, (cast(o_orderdate as date), o_orderkey)) as latest from orders where cast(o_orderdate as date) <= date '1996-06-30' group by 1")
def latest_name_asof(spark, sf_dir):
    return asof.latest(asof.visible(tables.orders(spark, sf_dir), "1996-06-30", "day"), "o_custkey", "o_orderpriority", "day", "o_orderkey")


@query(f"with {EV}, p as (select * from ev where type = 'purchase') select event_id, user_id, (select k from ev n where n.user_id = p.user_id and n.type = 'view' and n.published_at <= p.published_at order by n.published_at desc, n.event_id desc limit 1) as k_then from p")
def asof_scalar_subquery(spark, sf_dir):
    e = tables.events(spark, sf_dir)
    names = e.where("type = 'view'").select("user_id", "published_at", F.col("event_id").alias("n_id"), F.col("k").alias("k_then"))
    facts = e.where("type = 'purchase'").select("event_id", "user_id", "published_at")
    return asof.as_of_join(facts, names, "user_id", "published_at", "published_at", "k_then", "n_id").drop("published_at")


def feed_rows(spark, sf_dir, as_of: str = AS_OF) -> DataFrame:
    return feed_of(tables.events(spark, sf_dir), as_of)


def feed_of(events: DataFrame, as_of: str) -> DataFrame:
    """One week's capital steps, as of a day: cancelled ones out, with tier, latest attribute, confirmation and status."""
    v = asof.visible(events, as_of)
    start = F.date_trunc("week", F.lit(as_of).cast("date")).cast("date")
    window = v.where((F.col("published_at") >= start) & ((F.col("published_at") <= F.date_add(start, 6)) | (F.col("type") == "error")))
    steps = asof.uncancelled(window.where("type = 'purchase'"), _cancellations(window), "event_id")
    names = asof.latest(v.where("type = 'view'"), "user_id", "k", "published_at", "event_id").withColumnRenamed("latest", "latest_attribute")
    clicks = v.where("type = 'click'").groupBy("user_id").agg(F.max((F.col("k") >= 90).cast("int")).alias("high"), F.max((F.col("k") >= 50).cast("int")).alias("low"))
    told = steps.join(names, "user_id", "left").join(clicks, "user_id", "left").withColumn("tier", domain.tier(_score()))
    confirmed, possible = F.coalesce("high", F.lit(0)) == 1, F.coalesce("low", F.lit(0)) == 1
    return told.select("event_id", "user_id", "published_at", "type", "amount", "tier", "latest_attribute", confirmed.alias("confirmed"), domain.status(F.col("tier"), confirmed, possible).alias("status"))


@query(
    f"""with {VIS}, w as (select * from vis where published_at >= date_trunc('week', date '{AS_OF}')), c2 as (select distinct event_id - 1 - k as event_id from w where type = 'error'),
 names as (select user_id, arg_max(k, (published_at, event_id)) as latest_attribute from vis where type = 'view' group by 1),
 cl as (select user_id, max(k) >= 90 as high, max(k) >= 50 as low from vis where type = 'click' group by 1),
 t as (select s.*, {TIER} as tier from w s anti join c2 on s.event_id = c2.event_id where s.type = 'purchase')
 select t.event_id, t.user_id, t.published_at, t.type, t.amount, t.tier, n.latest_attribute, coalesce(cl.high, false) as confirmed,
 case when coalesce(cl.high, false) then case when tier = 'likely_financing' then 'confirmed' else 'confirmed_missed' end when coalesce(cl.low, false) then 'possible_confirmation' else tier end as status
 from t left join names n using (user_id) left join cl using (user_id)"""
)
def feed_week(spark, sf_dir):
    return feed_rows(spark, sf_dir).orderBy(F.desc("published_at"), F.desc("event_id"))


@query(f"with {VIS} select published_at, count(*) filter (where {TIER} = 'likely_financing') as likely, count(*) filter (where {TIER} = 'abstain') as undecided, count(*) filter (where {TIER} = 'capital_increased') as increased from vis where type = 'purchase' group by 1")
def daily_series(spark, sf_dir):
    t = _visible(spark, sf_dir).where("type = 'purchase'").withColumn("tier", domain.tier(_score()))
    n = lambda x: F.count_if(F.col("tier") == x)
    return t.groupBy("published_at").agg(n("likely_financing").alias("likely"), n("abstain").alias("undecided"), n("capital_increased").alias("increased"))


@query(f"with {VIS} select k // 4 as region, count(*) as n from vis where type = 'purchase' and k >= 60 and published_at > date '{AS_OF}' - 30 group by 1")
def region_counts(spark, sf_dir):
    v = _visible(spark, sf_dir).where("type = 'purchase' and k >= 60").where(F.col("published_at") > F.date_sub(F.lit(AS_OF).cast("date"), 30))
    return v.groupBy(F.floor(F.col("k") / 4).cast("int").alias("region")).agg(F.count("*").alias("n"))


@query(f"with {VIS} select {TIER} as tier, count(*) as n from vis where type = 'purchase' group by 1")
def tier_histogram(spark, sf_dir):
    return _visible(spark, sf_dir).where("type = 'purchase'").groupBy(domain.tier(_score()).alias("tier")).agg(F.count("*").alias("n"))


@query(f"with {VIS} select user_id, count(*) as n, min(published_at) as earliest, min(published_at) filter (where type = 'signup') as founded, 'since ' || strftime(min(published_at), '%-d %b %Y') as line from vis group by 1")
def source_coverage(spark, sf_dir):
    a = _visible(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.min("published_at").alias("earliest"), F.min(F.when(F.col("type") == "signup", F.col("published_at"))).alias("founded"))
    return a.withColumn("line", F.concat(F.lit("since "), dates.display(F.col("earliest"))))


@query(f"""with {VIS}, x as (select user_id from vis where type = 'purchase' and k > 50 group by 1)
 select v.user_id, count(*) as entries, min(v.published_at) as first_day, max(v.published_at) as last_day, sum(amount) filter (where type = 'purchase') as amount, arg_max(k, (v.published_at, v.event_id)) filter (where type = 'view') as attribute
 from vis v semi join x using (user_id) group by 1""")
def entity_record(spark, sf_dir):
    """Only entities with a visible increase have a record; all facts are cut at the day."""
    v = _visible(spark, sf_dir)
    has = v.where("type = 'purchase' and k > 50").select("user_id")
    own = v.join(has, "user_id", "left_semi")
    when = lambda t, c: F.when(F.col("type") == t, F.col(c))
    order = F.when(F.col("type") == "view", F.struct("published_at", "event_id"))
    return own.groupBy("user_id").agg(
        F.count("*").alias("entries"), F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"), F.sum(when("purchase", "amount")).cast("decimal(38,2)").alias("amount"), F.max_by("k", order).alias("attribute")
    )


@query(f"with {EV} select max(published_at) as last_day, count(distinct published_at) as days from ev where type = 'purchase'")
def max_day(spark, sf_dir):
    return tables.events(spark, sf_dir).where("type = 'purchase'").agg(F.max("published_at").alias("last_day"), F.count_distinct("published_at").alias("days"))


@query(f"with {EV} select event_id, published_at, type from ev where published_at between date '2024-01-08' and date '{AS_OF}' and (published_at <= date '2024-01-14' or type = 'error')")
def feed_window(spark, sf_dir):
    v = _visible(spark, sf_dir).where(F.col("published_at") >= F.lit("2024-01-08").cast("date"))
    return v.where((F.col("published_at") <= F.lit("2024-01-14").cast("date")) | (F.col("type") == "error")).select("event_id", "published_at", "type")


@query(f"with {EV} select distinct user_id from ev where type = 'purchase' and k > 50 and published_at >= date '2024-01-05'")
def increase_filter(spark, sf_dir):
    e = tables.events(spark, sf_dir).where("type = 'purchase' and k > 50").where(F.col("published_at") >= F.lit("2024-01-05").cast("date"))
    return e.select("user_id").distinct()


@query(f"""with {VIS} select case when {TIER} = 'likely_financing' then 'likely' when {TIER} = 'abstain' then 'undecided' else 'increased' end as feed_group, count(*) as n, sum(amount) as amount from vis where type = 'purchase' group by 1""")
def feed_filter_groups(spark, sf_dir):
    t = _visible(spark, sf_dir).where("type = 'purchase'").withColumn("tier", domain.tier(_score()))
    return t.groupBy(domain.feed_group(F.col("tier"), F.col("tier")).alias("feed_group")).agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query("""with ptr as (select max(o_orderdate) as d from orders) select o.o_orderkey, c.c_name, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(38,2)) as amount
 from orders o join customer c on o.o_custkey = c.c_custkey join lineitem l on o.o_orderkey = l.l_orderkey join ptr on o.o_orderdate <= ptr.d group by 1, 2""")
def release_join(spark, sf_dir):
    o, c, li = tables.orders(spark, sf_dir), tables.table(spark, sf_dir, "customer"), tables.lines(spark, sf_dir)
    pointer = o.agg(F.max("day").alias("current"))  # one row
    per = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount"))
    own = o.join(F.broadcast(pointer), F.col("day") <= F.col("current")).join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    return own.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "n", "amount")


@query(f"with {EV} select e.event_id, l.quality, d.lang from ev e left join labels l on e.event_id = l.doc_id left join documents d on e.event_id = d.doc_id where e.type = 'purchase'")
def score_left_join(spark, sf_dir):
    e = tables.events(spark, sf_dir).where("type = 'purchase'").select("event_id")
    lab, docs = tables.table(spark, sf_dir, "labels").select("doc_id", "quality"), tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return e.join(lab, e.event_id == lab.doc_id, "left").drop("doc_id").join(docs, e.event_id == docs.doc_id, "left").select("event_id", "quality", "lang")


@query(f"with {VIS} select s.event_id, count(c.event_id) as confirmations, coalesce(max(c.k) >= 90, false) as confirmed from vis s left join vis c on s.user_id = c.user_id and c.type = 'click' where s.type = 'purchase' group by 1")
def confirmation_collect(spark, sf_dir):
    v = _visible(spark, sf_dir)
    per = v.where("type = 'click'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("k").alias("top"))
    return v.where("type = 'purchase'").join(per, "user_id", "left").select("event_id", F.coalesce("n", F.lit(0)).cast("long").alias("confirmations"), F.coalesce(F.col("top") >= 90, F.lit(False)).alias("confirmed"))


@query(f"""with {EV}, e as (select * from ev where type = 'error'), done as (select distinct user_id from ev where type = 'signup' and k > 90) select distinct user_id from e where k not in (0, 50) and user_id not in (select user_id from done)""")
def retryable_worklist(spark, sf_dir):
    e = tables.events(spark, sf_dir)
    return e.where("type = 'error' and k not in (0, 50)").select("user_id").distinct().join(e.where("type = 'signup' and k > 90").select("user_id"), "user_id", "left_anti")


@query("select page_id, case when regexp_extract(url, '^([a-z]+)://', 1) = 'https' then url end as https_url from pages")
def https_only(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", text.https_only(F.col("url")).alias("https_url"))


@query(f"""with {EV}, s as (select *, lag(amount) over (partition by user_id order by published_at, event_id) as before from ev where type = 'purchase')
 select event_id, case when k % 10 = 0 then case when k >= 50 then 'increase' else 'unchanged' end when amount > before then 'increase' when amount < before then 'reduction' else 'unchanged' end as direction,
 case {TIER} when 'likely_financing' then 'strong' when 'abstain' then 'open' else 'plain' end as tone from s""")
def direction_and_tone(spark, sf_dir):
    from pyspark.sql import Window

    s = tables.events(spark, sf_dir).where("type = 'purchase'").withColumn("before", F.lag("amount").over(Window.partitionBy("user_id").orderBy("published_at", "event_id")))
    tier = domain.tier(_score())
    return s.select("event_id", domain.direction(F.col("before"), F.col("amount"), F.col("k") % 10 == 0, F.col("k") >= 50).alias("direction"), F.when(tier == "likely_financing", "strong").when(tier == "abstain", "open").otherwise("plain").alias("tone"))


@query(f"with {VIS} select event_id, user_id, row_number() over (order by published_at desc, event_id desc) as feed_rank, row_number() over (partition by user_id order by published_at, event_id) as record_rank, row_number() over (partition by user_id order by published_at desc, event_id desc) <= 12 as shown from vis")
def sorted_views(spark, sf_dir):
    """The feed's order over all rows is a rank over ranges: counted by day, then within the day."""
    from pyspark.sql import Window

    v = _visible(spark, sf_dir)
    days = v.groupBy("published_at").agg(F.count("*").alias("n")).withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("published_at")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("user_id")
    ranked = v.join(F.broadcast(days), "published_at")  # one row for each day
    return ranked.select(
        "event_id", "user_id", (F.col("above") + F.row_number().over(Window.partitionBy("published_at").orderBy(F.desc("event_id")))).alias("feed_rank"),
        F.row_number().over(own.orderBy("published_at", "event_id")).cast("long").alias("record_rank"), (F.row_number().over(own.orderBy(F.desc("published_at"), F.desc("event_id"))) <= 12).alias("shown"),
    )


@query("""with k as (select user_id, row_number() over (order by user_id) - 1 as r, count(*) over () as n from (select distinct user_id from events)), d as (select range as draw, ('0x' || substr(md5('leaks:' || range), 1, 8))::bigint as u from range(40))
 select d.draw::bigint as draw, k.user_id from d join k on k.r = (d.u * k.n) >> 32""")
def drawn_keys(spark, sf_dir):
    """Entities drawn with replacement, whose outputs are rewound to look for leaks."""
    return leaks.draws(tables.events(spark, sf_dir), "user_id", 40, "leaks")
