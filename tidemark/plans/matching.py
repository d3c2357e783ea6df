"""Joins by name and by interval, source unions and idempotent appends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import canonical, text
from tidemark.operators import asof
from tidemark.plans.catalogue import query
from tidemark.plans.feed import EV
from tidemark.sources import tables

_PAIRS = """p as (select o_orderkey, cast(o_orderdate as date) as od, cast(l_shipdate as date) as sd, l_partkey, l_suppkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey where cast(l_shipdate as date) between cast(o_orderdate as date) - 120 and cast(o_orderdate as date) + 180)"""


def _pairs(spark, sf_dir):
    o = tables.orders(spark, sf_dir).select("o_orderkey", F.col("day").alias("od"))
    li = tables.lines(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("day").alias("sd"), "l_partkey", "l_suppkey", "l_linenumber")
    return asof.interval_match(o, li, "o_orderkey", "od", "sd", 120, 180)


@query(f"with {_PAIRS} select o_orderkey, count(*) as matches, arg_min(l_partkey, (abs(date_diff('day', od, sd)), sd, l_partkey, l_suppkey, l_linenumber)) as nearest, min(abs(date_diff('day', od, sd))) as lag_days, case when count(*) = 1 then 'high' else 'low' end as confidence, case when count(*) = 1 then 'accepted' else 'uncertain' end as event_match from p group by 1")
def interval_match(spark, sf_dir):
    gap = F.abs(F.datediff("sd", "od")).cast("long")
    one = F.count("*") == 1
    return _pairs(spark, sf_dir).groupBy("o_orderkey").agg(
        F.count("*").alias("matches"), F.min_by("l_partkey", F.struct(gap, "sd", "l_partkey", "l_suppkey", "l_linenumber")).alias("nearest"), F.min(gap).alias("lag_days"),
        F.when(one, "high").otherwise("low").alias("confidence"), F.when(one, "accepted").otherwise("uncertain").alias("event_match"),
    )


@query(f"with {_PAIRS} select year(od) as year, count(*) as n, median(date_diff('day', od, sd)) as median_lag, list_sort(list(date_diff('day', od, sd)))[count(*) // 2 + 1] as upper_median from p group by 1")
def lead_time_stats(spark, sf_dir):
    """The upper median is taken from counts of each lag, of which an interval has 301."""
    lags = _pairs(spark, sf_dir).groupBy(F.year("od").cast("long").alias("year"), F.datediff("sd", "od").cast("long").alias("lag")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("year").orderBy("lag")
    run = lags.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("year")))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("lag")))
    half = F.floor(F.col("n") / 2)
    return run.groupBy("year").agg(F.max("n").alias("n"), ((at(half) + at(F.floor((F.col("n") - 1) / 2))) / 2).alias("median_lag"), at(half).alias("upper_median"))


@query("with s as (select s_suppkey, lower(replace(s_name, '#', ' ')) as n from supplier), c as (select c_custkey, lower(replace(c_name, '#', ' ')) as n from customer) select s_suppkey, c_custkey from s join c on regexp_replace(s.n, '^supplier', '') = regexp_replace(c.n, '^customer', '')")
def name_match(spark, sf_dir):
    norm = lambda c: F.regexp_replace(text.name_stem(F.col(c)), r"^(supplier|customer) ", "")
    s = tables.table(spark, sf_dir, "supplier").select("s_suppkey", norm("s_name").alias("n"))
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", norm("c_name").alias("n"))
    return s.join(c, "n").select("s_suppkey", "c_custkey")


@query("select p_partkey, cast(p_size * 100000 as bigint) as amount, case when p_size % 2 = 0 then 'CHF' else 'EUR' end as currency, case when p_size % 3 = 0 then 'seed' when p_size % 3 = 1 then 'series a' end as stage from part")
def stated_amount(spark, sf_dir):
    """Titles written from the part table and read back."""
    size, cur = F.col("p_size"), F.when(F.col("p_size") % 2 == 0, "CHF").otherwise("EUR")
    number = F.format_string("%.1f", size / 10)
    said = F.when(size % 4 < 2, F.concat(cur, F.lit(" "), number, F.lit(" million"))).otherwise(F.concat(number, F.lit(" mio "), cur))
    title = F.concat(F.col("p_name"), F.lit(" raises "), said, F.when(size % 3 == 0, " in Seed round").when(size % 3 == 1, " Series A").otherwise(" today"))
    told = tables.table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))
    amount, currency = text.stated_amount(F.col("title"))
    return told.select("p_partkey", amount.alias("amount"), currency.alias("currency"), text.stage(F.col("title")).alias("stage"))


@query("with u as (select doc_id from documents where lang = 'de' union all select doc_id from documents where source = 'src0' union all select doc_id from documents where n_chars > 2000) select doc_id, count(*) as listed from u group by 1")
def source_union_dedupe(spark, sf_dir):
    """One scan: each row says how many of the lists name it."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    flags = [F.when(F.expr(c), 1).otherwise(0) for c in ("lang = 'de'", "source = 'src0'", "n_chars > 2000")]
    named = d.select("doc_id", (flags[0] + flags[1] + flags[2]).cast("long").alias("n")).where("n > 0")
    return named.groupBy("doc_id").agg(F.sum("n").alias("listed"))


@query("""with d as (select sha256(text) as input_hash, doc_id, doc_id % 3 as batch from documents where text is not null), a as (select input_hash, min(doc_id) as first_id, 1 as batch from d where batch < 2 group by 1)
 select * from a union all select input_hash, min(doc_id), 2 from d where batch = 2 and input_hash not in (select input_hash from a) group by 1""")
def idempotent_append(spark, sf_dir):
    """Texts by their hash in two batches: the second adds only what the first does not hold (an anti join on the hash)."""
    d = tables.table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("input_hash"), "doc_id", (F.col("doc_id") % 3).alias("batch"))
    batch = lambda rows, n: rows.groupBy("input_hash").agg(F.min("doc_id").alias("first_id")).withColumn("batch", F.lit(n))
    stored = batch(d.where("batch < 2"), 1)
    return stored.unionByName(batch(d.where("batch = 2").join(stored.select("input_hash"), "input_hash", "left_anti"), 2))


@query("""select p_partkey, sha256('{"brand":"' || p_brand || '","of":{"none":null,"note":"é \\"q\\"","size":' || p_size || '},"p_type":"' || p_type || '"}') as input_hash from part""")
def input_hash(spark, sf_dir):
    """A nested value hashed by its canonical JSON, whatever the order of its fields."""
    value = F.struct("p_type", F.struct(F.col("p_size").alias("size"), F.lit('é "q"').alias("note"), F.lit(None).cast("string").alias("none")).alias("of"), F.col("p_brand").alias("brand"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", canonical.fingerprint(value).alias("input_hash"))


@query(f"with {EV}, cache as (select k, type, user_id % 3 as version, min(event_id) as cached_id from ev where published_at <= date '2024-01-10' group by 1, 2, 3) select e.event_id, c.cached_id, c.cached_id is null as fresh from ev e left join cache c on e.k = c.k and e.type = c.type and e.user_id % 3 = c.version where e.published_at > date '2024-01-10'")
def cache_lookup(spark, sf_dir):
    """Answers are cached by input, model and prompt version; an input asked with another version is fresh."""
    e, cut = tables.events(spark, sf_dir).withColumn("version", F.col("user_id") % 3), F.lit("2024-01-10").cast("date")
    cache = e.where(F.col("published_at") <= cut).groupBy("k", "type", "version").agg(F.min("event_id").alias("cached_id"))
    return e.where(F.col("published_at") > cut).join(cache, ["k", "type", "version"], "left").select("event_id", "cached_id", F.col("cached_id").isNull().alias("fresh"))


@query("select l_suppkey, count(*) filter (where l_partkey % 10 = l_suppkey % 10) as own, count(*) filter (where l_partkey % 10 <> l_suppkey % 10) as foreign_mentions from lineitem group by 1")
def owner_filter(spark, sf_dir):
    own = F.col("l_partkey") % 10 == F.col("l_suppkey") % 10
    return tables.lines(spark, sf_dir).groupBy("l_suppkey").agg(F.count_if(own).alias("own"), F.count_if(~own).alias("foreign_mentions"))


@query("select c_custkey, 'CHE' || lpad(cast(c_custkey as varchar), 9, '0') as uid, 'CHE-' || substr(lpad(cast(c_custkey as varchar), 9, '0'), 1, 3) || '.' || substr(lpad(cast(c_custkey as varchar), 9, '0'), 4, 3) || '.' || substr(lpad(cast(c_custkey as varchar), 9, '0'), 7, 3) as shown from customer")
def uid_normalize(spark, sf_dir):
    raw = F.concat(F.lit(" che-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    told = tables.table(spark, sf_dir, "customer").select("c_custkey", text.uid(raw).alias("uid"))
    return told.withColumn("shown", text.display_uid(F.col("uid")))


@query("""with n as (select l_orderkey, count(*) as lines from lineitem group by 1) select cast(o_orderkey as varchar) as number, strftime(o_orderdate, '%Y-%m-%d') as published_at, c_name as company, coalesce(cast(lines as varchar), '') as lines, case when o_orderstatus = 'P' then 'not_assessed' else o_orderstatus end as tier, case when o_orderstatus = 'P' then '' else cast(cast(o_totalprice as decimal(18,2)) as varchar) end as score from orders left join customer on o_custkey = c_custkey left join n on o_orderkey = l_orderkey""")
def export_rows(spark, sf_dir):
    n = tables.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    o = tables.orders(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    un = F.col("o_orderstatus") == "P"
    return o.select(
        F.col("o_orderkey").cast("string").alias("number"), F.date_format("day", "yyyy-MM-dd").alias("published_at"), F.col("c_name").alias("company"), F.coalesce(F.col("lines").cast("string"), F.lit("")).alias("lines"),
        F.when(un, "not_assessed").otherwise(F.col("o_orderstatus")).alias("tier"), F.when(un, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("score"),
    )
