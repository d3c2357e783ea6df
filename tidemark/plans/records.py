"""Record queries: carried share counts, linked rows, tallies, timelines, span bounds, scalars of display."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import records
from tidemark.plans.catalogue import query
from tidemark.plans.feed import AS_OF, EV
from tidemark.sources import tables


@query(f"""with {EV}, s as (select *, case when k % 4 <> 0 then k end as stated, type = 'signup' as formation from ev),
 g as (select *, sum(case when formation then 1 else 0 end) over (partition by user_id order by published_at, event_id rows unbounded preceding) as era from s)
 select event_id, coalesce(stated, last_value(stated ignore nulls) over w) as shares, case when stated is not null then 'entry' when last_value(stated ignore nulls) over w is not null then 'previous_event' else 'unknown' end as shares_source
 from g window w as (partition by user_id, era order by published_at, event_id rows between unbounded preceding and 1 preceding)""")
def share_carry(spark, sf_dir):
    """An unknown share count takes the entity's last known one since its formation, and says so."""
    s = tables.events(spark, sf_dir).select("event_id", "user_id", "published_at", F.when(F.col("k") % 4 != 0, F.col("k")).alias("stated"), (F.col("type") == "signup").cast("int").alias("formation"))
    own = Window.partitionBy("user_id").orderBy("published_at", "event_id")
    eras = s.withColumn("era", F.sum("formation").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last("stated", ignorenulls=True).over(Window.partitionBy("user_id", "era").orderBy("published_at", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    told = eras.withColumn("before", before)
    source = F.when(F.col("stated").isNotNull(), "entry").when(F.col("before").isNotNull(), "previous_event").otherwise("unknown")
    return told.select("event_id", F.coalesce("stated", "before").alias("shares"), source.alias("shares_source"))


@query(f"""with {EV} select c.event_id, case when e.published_at <= date '{AS_OF}' then e.event_id end as matched from ev c left join ev e on e.event_id = c.event_id + 7 + c.k and e.type = 'purchase' where c.type = 'click' and c.published_at <= date '{AS_OF}'""")
def linked_mask(spark, sf_dir):
    """A confirmation's match is hidden while the event it names is not visible."""
    e, cut = tables.events(spark, sf_dir), F.lit(AS_OF).cast("date")
    seen = e.where((F.col("type") == "purchase") & (F.col("published_at") <= cut)).select(F.col("event_id").alias("matched"))
    c = e.where((F.col("type") == "click") & (F.col("published_at") <= cut)).select("event_id", (F.col("event_id") + 7 + F.col("k")).alias("names"))
    return c.join(seen, F.col("names") == F.col("matched"), "left").select("event_id", "matched")


@query("select l_orderkey, l_linenumber, o_orderkey as matched_event from lineitem left join orders on o_orderkey = l_partkey and o_orderstatus = 'F'")
def matched_event(spark, sf_dir):
    """A matched publication's number to the event of its kind, null if there is none."""
    steps = tables.orders(spark, sf_dir).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("matched_event"))
    lines = tables.lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey")
    return lines.join(steps, F.col("l_partkey") == F.col("matched_event"), "left").select("l_orderkey", "l_linenumber", "matched_event")


@query("""with w as (select o_orderkey, cast(date_trunc('week', o_orderdate) as date) as week from orders), b as (select min(week) as first, max(week) as last from w)
 select o_orderkey, case when week - 7 >= first then week - 7 end as previous_week, case when week + 7 <= last then week + 7 end as next_week from w, b""")
def week_steps(spark, sf_dir):
    w = tables.orders(spark, sf_dir).select("o_orderkey", F.trunc("day", "week").alias("week"))
    bounds = w.agg(F.min("week").alias("first"), F.max("week").alias("last"))
    first, last = bounds.select("first").scalar(), bounds.select("last").scalar()
    return w.select("o_orderkey", records.step_week(F.col("week"), -1, first, last).alias("previous_week"), records.step_week(F.col("week"), 1, first, last).alias("next_week"))


@query("""with b as (select cast(min(o_orderdate) as date) as first, cast(max(o_orderdate) as date) as last from orders), s as (select unnest(generate_series(first, last, interval 31 days)) as s, last from b)
 select cast(s as date) as chunk_start, least(cast(s as date) + 30, last) as chunk_end from s""")
def date_chunks(spark, sf_dir):
    """The window of the table in ranges of 31 days, as a source with a limit is asked."""
    b = tables.orders(spark, sf_dir).agg(F.min("day").alias("first"), F.max("day").alias("last"))
    return b.select(F.explode(records.chunks(F.col("first"), F.col("last"), 31)).alias("c")).select(F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))


@query("""with d as (select doc_id, md5('x1' || doc_id) as draw, case doc_id % 5 when 0 then 'verified' when 1 then 'refuted' else 'unverifiable' end as verdict, doc_id % 3 <> 0 as eligible from documents),
 r as (select verdict, row_number() over (order by draw, doc_id) as place from d where eligible) select verdict, count(*) as n, count(*) >= 4 as claim from r where place <= 10 group by 1""")
def sequential_tally(spark, sf_dir):
    """The first ten eligible in drawing order, by verdict; a claim stands from four on. Each task keeps its own first ten."""
    d = tables.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.md5(F.concat(F.lit("x1"), F.col("doc_id").cast("string"))).alias("draw"))
    verdict = F.when(F.col("doc_id") % 5 == 0, "verified").when(F.col("doc_id") % 5 == 1, "refuted").otherwise("unverifiable")
    return d.orderBy("draw", "doc_id").limit(10).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), (F.count("*") >= 4).alias("claim"))


@query("""with o as (select o_custkey, o_orderkey, md5('draw' || o_orderkey) as draw from orders where o_orderpriority <> '5-LOW') select o_custkey, min_by(o_orderkey, draw) as drawn from o group by 1""")
def first_acceptable(spark, sf_dir):
    """Of each entity the first acceptable item in drawing order."""
    o = tables.orders(spark, sf_dir).where("o_orderpriority <> '5-LOW'")
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.md5(F.concat(F.lit("draw"), F.col("o_orderkey").cast("string")))).alias("drawn"))


@query("""with s as (select doc_id, length(text) as n, doc_id % 700 as a, doc_id % 700 + 150 as b, case doc_id % 3 when 0 then 'capital' when 1 then 'purpose' else 'name' end as kind from documents where text is not null)
 select kind, count(*) as spans, count(*) filter (where b > n or a >= b) as violations from s where kind in ('capital', 'purpose') group by 1""")
def span_violations(spark, sf_dir):
    """Spans of the kinds that an event cites, and how many of them leave their text."""
    s = tables.table(spark, sf_dir, "documents").where("text is not null").select(F.length("text").alias("n"), (F.col("doc_id") % 700).alias("a"), F.when(F.col("doc_id") % 3 == 0, "capital").when(F.col("doc_id") % 3 == 1, "purpose").otherwise("name").alias("kind"))
    spans = s.where(F.col("kind").isin("capital", "purpose")).withColumn("b", F.col("a") + 150)
    return spans.groupBy("kind").agg(F.count("*").alias("spans"), F.count_if((F.col("b") > F.col("n")) | (F.col("a") >= F.col("b"))).alias("violations"))


@query("""select count(*) as shared from (select o_custkey from orders where o_orderkey % 2 = 0 intersect select o_custkey from orders where o_orderkey % 7 = 1)""")
def partition_overlap(spark, sf_dir):
    """How many keys two parts share; a sealed split demands none."""
    o = tables.orders(spark, sf_dir)
    return o.where("o_orderkey % 2 = 0").select("o_custkey").intersect(o.where("o_orderkey % 7 = 1").select("o_custkey")).agg(F.count("*").alias("shared"))


@query(f"""with {EV}, t as (select user_id as entity, published_at as day, event_id as number, 'event' as kind from ev union all select o_custkey, cast(o_orderdate as date), o_orderkey, 'order' from orders)
 select entity, day, number, kind, row_number() over (partition by entity order by day, number, kind) as place from t""")
def timeline_merge(spark, sf_dir):
    """Two dated lists as one timeline of each entity, in export order."""
    e = tables.events(spark, sf_dir).select(F.col("user_id").alias("entity"), F.col("published_at").alias("day"), F.col("event_id").alias("number"), F.lit("event").alias("kind"))
    o = tables.orders(spark, sf_dir).select(F.col("o_custkey").alias("entity"), "day", F.col("o_orderkey").alias("number"), F.lit("order").alias("kind"))
    return e.unionByName(o).withColumn("place", F.row_number().over(Window.partitionBy("entity").orderBy("day", "number", "kind")).cast("long"))


@query("""select p_partkey, array_to_string(list_transform(list_sort(list_transform(list_distinct(string_split(p_name || ' ' || p_type, ' ')), lambda t: lpad((1000 - length(t))::varchar, 4, '0') || t)), lambda x: substr(x, 5)), '|') as terms,
 regexp_matches(lower(p_type), '(^|[^a-z])(steel|copper)([^a-z]|$)') as tech, case when p_size <= 5 then 'AG' when p_size <= 10 then 'GmbH' else '0' || p_size end as form, 'https://example.org/p?id=' || p_partkey || '%2F' || p_size as link from part""")
def text_scalars(spark, sf_dir):
    """Scalars of display: terms as they must be replaced, a vocabulary's words, short legal forms, links with escaped numbers."""
    p = tables.table(spark, sf_dir, "part")
    code = F.when(F.col("p_size") <= 5, "0106").when(F.col("p_size") <= 10, "0107").otherwise(F.concat(F.lit("0"), F.col("p_size").cast("string")))
    number = F.concat(F.col("p_partkey").cast("string"), F.lit("/"), F.col("p_size").cast("string"))
    return p.select(
        "p_partkey", F.array_join(records.longest_first(F.split(F.concat("p_name", F.lit(" "), "p_type"), " ")), "|").alias("terms"), F.lower("p_type").rlike("(^|[^a-z])(steel|copper)([^a-z]|$)").alias("tech"),
        records.legal_form(code).alias("form"), F.concat(F.lit("https://example.org/p?id="), F.url_encode(number)).alias("link"),
    )


@query("""select doc_id, case when upper(lang) in ('AG', 'AI', 'AR', 'BE', 'BL', 'BS', 'FR', 'GE', 'GL', 'GR', 'JU', 'LU', 'NE', 'NW', 'OW', 'SG', 'SH', 'SO', 'SZ', 'TG', 'TI', 'UR', 'VD', 'VS', 'ZG', 'ZH') then upper(lang) end as canton from documents""")
def canton_valid(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", records.canton(F.col("lang")).alias("canton"))


@query("""with c as (select lang, count(*) as n, count(*) filter (where n_chars > 1500) as hit from documents group by 1)
 select lang, hit || ' of ' || n || case when n = 1 then ' document' else ' documents' end || ' (' || printf('%.1f', round(100.0 * hit / n, 1)) || '%)' as line from c""")
def metric_lines(spark, sf_dir):
    c = tables.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1500).alias("hit"))
    return c.select("lang", records.metric_line(F.col("hit"), F.col("n"), "document").alias("line"))


@query(f"with {EV} select distinct published_at as day from ev where published_at <= date '{AS_OF}'")
def distinct_days(spark, sf_dir):
    """The days with a visible publication."""
    return tables.events(spark, sf_dir).where(F.col("published_at") <= F.lit(AS_OF).cast("date")).select(F.col("published_at").alias("day")).distinct()


@query("select event_id, case when cast(json_extract_string(props, '$.k') as int) between 0 and 80 then cast(json_extract_string(props, '$.k') as int) end as k from events")
def checked_json(spark, sf_dir):
    """A stored result is read only if it is well formed and in its range, else null."""
    raw = tables.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").alias("v"))
    return raw.select("event_id", F.when(F.col("v.k").between(0, 80), F.col("v.k")).alias("k"))


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') as statuses, count(*) as n, max(o_totalprice) as largest, cast(max(o_orderdate) as date) as latest from orders group by 1")
def compact_view(spark, sf_dir):
    """One flat row for each entity, for a listing."""
    o = tables.orders(spark, sf_dir).groupBy("o_custkey")
    return o.agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.count("*").alias("n"), F.max("o_totalprice").alias("largest"), F.max("day").alias("latest"))
