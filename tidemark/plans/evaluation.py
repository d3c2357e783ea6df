"""Evaluation queries: intervals, thresholds, samples, gates, releases."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import sampling
from tidemark.plans.catalogue import query
from tidemark.plans.feed import EV
from tidemark.sources import tables

_DL = "dl as (select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic from documents d join labels l using (doc_id))"
_Z = stats.Z
_WILSON = f"""round(case when n = 0 or k = 0 then 0.0 else (k + {_Z}*{_Z}/2 - {_Z} * sqrt(k * (n - k) / n::double + {_Z}*{_Z}/4)) / (n + {_Z}*{_Z}) end, 9) as low,
 round(case when n = 0 or k = n then 1.0 else (k + {_Z}*{_Z}/2 + {_Z} * sqrt(k * (n - k) / n::double + {_Z}*{_Z}/4)) / (n + {_Z}*{_Z}) end, 9) as high"""


def _labelled(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(tables.table(spark, sf_dir, "labels"), "doc_id")


@query(f"with {_DL}, g as (select source, count(*) as n, sum(quality)::bigint as k from dl group by 1) select source, n, k, {_WILSON} from g")
def wilson_by_group(spark, sf_dir):
    g = _labelled(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"with {_DL}, g as (select count(*) as n, count(*) filter (where quality = 1 and toxic = 0) as k from dl) select n, k, round(k / n::double, 9) as recall, {_WILSON} from g")
def recall_summary(spark, sf_dir):
    g = _labelled(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("n", "k", F.round(F.col("k") / F.col("n"), 9).alias("recall"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""with {_DL}, s as (select lang, count(*) as n, count(*) filter (where quality = 1) as hit, count(*) filter (where quality = 0 and toxic = 1) as open from dl group by 1), w as (select *, n / sum(n) over () as w from s)
 select sum(n)::bigint as n, round(sum(w * hit / n), 9) as estimate_low, round(sum(w * (hit + open) / n), 9) as estimate_high from w""")
def weighted_precision(spark, sf_dir):
    """Strata are few; what can't be verified counts as wrong below and as right above."""
    s = _labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("hit"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("open"))
    t = s.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return t.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("w") * F.col("hit") / F.col("n")), 9).alias("estimate_low"), F.round(F.sum(F.col("w") * (F.col("hit") + F.col("open")) / F.col("n")), 9).alias("estimate_high"))


@query(f"with {_DL} select lang, count(*) filter (where quality = 1 and toxic = 0) as verified, count(*) filter (where quality = 0) as refuted, count(*) filter (where quality = 1 and toxic = 1) as unverifiable from dl group by 1")
def verdict_join(spark, sf_dir):
    v = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "verified").when(F.col("quality") == 0, "refuted").otherwise("unverifiable")
    n = lambda x: F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
    p = _labelled(spark, sf_dir).withColumn("verdict", v).groupBy("lang").pivot("verdict", ["verified", "refuted", "unverifiable"]).count()
    return p.select("lang", n("verified"), n("refuted"), n("unverifiable"))


@query(f"""with {_DL}, i as (select least(n_chars // 500, 20) as score, quality = 1 as positive, toxic = 0 as candidate from dl), t as (select count(*) filter (where positive) as positives from i),
 s as (select distinct score from i where candidate), x as (select s.score, count(*) filter (where i.candidate and i.score >= s.score) as predicted, count(*) filter (where i.candidate and i.score >= s.score and positive) as tp from s, i group by 1),
 f as (select *, case when tp > 0 then 2.0 * tp / (predicted + positives) else 0.0 end::double as f1 from x, t) select score as threshold, round(f1, 9) as f1, tp, predicted - tp as fp, positives - tp as fn from f order by f1 desc, score desc limit 1""")
def threshold_fit(spark, sf_dir):
    i = _labelled(spark, sf_dir).select(F.least(F.floor(F.col("n_chars") / 500).cast("long"), F.lit(20).cast("long")).alias("score"), (F.col("quality") == 1).alias("positive"), (F.col("toxic") == 0).alias("candidate"))
    return stats.fit_threshold(i).withColumn("f1", F.round("f1", 9))


@query(f"""with {_DL}, i as (select case when quality = 1 then 40 + doc_id % 60 else doc_id % 55 end as score, quality = 1 as positive from dl), a as (select percentile_disc(0.2) within group (order by score) filter (where positive) as p20, coalesce(max(score) filter (where not positive), 0) as top from i),
 t as (select least(100, greatest(p20 // 5 * 5, case when p20 // 5 * 5 > top then p20 // 5 * 5 else (top // 5 + 1) * 5 end))::bigint as tau, top from a) select tau, least(tau, ceil((top + 5) / 5.0)::bigint * 5) as tau_low from t""")
def threshold_freeze(spark, sf_dir):
    i = _labelled(spark, sf_dir).select(F.when(F.col("quality") == 1, 40 + F.col("doc_id") % 60).otherwise(F.col("doc_id") % 55).alias("score"), (F.col("quality") == 1).alias("positive"))
    return stats.freeze_thresholds(i)


@query("""with p as (select 498.0 as nb, 414.0 as nr, 19.0 as nm, 931.0 as t), g as (select b, r, 30 - b - r as m from generate_series(0, 30) x(b), generate_series(0, 30) y(r) where b + r <= 30)
 select b, r, m from g, p where b >= 1 and r >= 1 and m >= 1 and m <= nm and b + r >= 10 and b + m >= 10 order by round((b - 30*nb/t)**2 + (r - 30*nr/t)**2 + (m - 30*nm/t)**2, 9), b, r limit 1""")
def sample_allocation(spark, sf_dir):
    return stats.allocation(spark, 498, 414, 19)


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by md5('20261007' || doc_id), doc_id) as n from documents) select doc_id, lang from r where n <= case lang when 'en' then 16 when 'de' then 13 when 'fr' then 5 else 0 end""")
def stratified_sample(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.stratified(d, "lang", "doc_id", {"en": 16, "de": 13, "fr": 5}, "20261007").select("doc_id", "lang")


@query("""with h as (select o_custkey, o_orderkey, row_number() over (order by md5('p' || o_orderkey), o_orderkey) as n from orders), s as (select distinct o_custkey from h where n <= 20),
 r as (select h.*, row_number() over (order by n) as m from h anti join s using (o_custkey)), c as (select distinct o_custkey from r where m <= 30)
 select case when o_custkey in (select o_custkey from s) then 'spike' when o_custkey in (select o_custkey from c) then 'cohort' else 'rest' end as part, count(*) as orders, count(distinct o_custkey) as customers from h group by 1""")
def partition_assign(spark, sf_dir):
    """The first 20 orders' customers, then the first 30 orders of others; no customer is in two parts."""
    o = tables.orders(spark, sf_dir).select("o_custkey", "o_orderkey")
    order = [sampling.hash_order("p", F.col("o_orderkey")), F.col("o_orderkey")]
    spike = o.orderBy(*order).limit(20).select("o_custkey").distinct()
    cohort = o.join(F.broadcast(spike), "o_custkey", "left_anti").orderBy(*order).limit(30).select("o_custkey").distinct()
    parts = spike.withColumn("part", F.lit("spike")).unionByName(cohort.withColumn("part", F.lit("cohort")))
    return o.join(F.broadcast(parts), "o_custkey", "left").groupBy(F.coalesce("part", F.lit("rest")).alias("part")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))


@query("""with h as (select doc_id, n_chars > 800 as eligible, md5('x' || doc_id) as h from documents), e as (select h, doc_id from h where eligible order by 1, 2 limit 10), last as (select max((h, doc_id)) as l from e)
 select count(*) as seen, count(*) filter (where eligible) as evaluated from h, last where (h, doc_id) <= l""")
def sequential_eligibility(spark, sf_dir):
    """Rows in hash order up to the tenth eligible one."""
    d = tables.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 800).alias("eligible"), sampling.hash_order("x", F.col("doc_id")).alias("h"))
    last = d.where("eligible").orderBy("h", "doc_id").limit(10).agg(F.max(F.struct("h", "doc_id")).alias("last"))
    return d.join(F.broadcast(last), F.struct("h", "doc_id") <= F.col("last")).agg(F.count("*").alias("seen"), F.count_if("eligible").alias("evaluated"))


@query("""with s as (select c_custkey from customer where c_mktsegment = 'BUILDING' union select o_custkey from orders where o_orderpriority = '1-URGENT') select c_custkey from customer where c_custkey not in (select c_custkey from s)""")
def sealed_exclusion(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    sealed = c.where("c_mktsegment = 'BUILDING'").select("c_custkey").union(tables.orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select("o_custkey")).distinct()
    return c.select("c_custkey").join(sealed, "c_custkey", "left_anti")


@query(f"""with {EV}, g as (select count(*) as n, count(*) filter (where k is null) as failures, count(*) filter (where type = 'purchase') as candidates, count(*) filter (where type = 'purchase' and k < 3) as errors, count(distinct published_at) filter (where isodow(published_at) < 6) as days from ev)
 select round(failures / n::double, 9) as parse_rate, round(errors / candidates::double, 9) as error_rate, days, failures / n::double <= 0.05 as parse_ok, errors / candidates::double <= 0.05 as scorer_ok from g""")
def release_gates(spark, sf_dir):
    buy = F.col("type") == "purchase"
    g = tables.events(spark, sf_dir).agg(
        F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("failures"), F.count_if(buy).alias("candidates"), F.count_if(buy & (F.col("k") < 3)).alias("errors"), F.count_distinct(F.when(F.weekday("published_at") < 5, F.col("published_at"))).alias("days")
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return g.select(F.round(rate("failures", "n"), 9).alias("parse_rate"), F.round(rate("errors", "candidates"), 9).alias("error_rate"), "days", (rate("failures", "n") <= 0.05).alias("parse_ok"), (rate("errors", "candidates") <= 0.05).alias("scorer_ok"))


_RELEASES = "(values ('r1', 'ready', false), ('r2', 'ready', false), ('r3', 'failed', false), ('r9', 'ready', true), ('r10', 'ready', false), ('r11', 'building', false)) r(id, status, is_current)"


@query(f"with r as (select *, cast(substr(id, 2) as int) as n from {_RELEASES}), k as (select id, row_number() over (order by n desc) as p from r where status = 'ready' and not is_current) select id from r where status <> 'building' and not is_current and id not in (select id from k where p <= 2)")
def release_prune(spark, sf_dir):
    from tidemark.operators import releases

    return releases.to_prune(_releases(spark), 3)


@query(f"select 'r' || (max(cast(substr(id, 2) as int)) + 1) as next_id from {_RELEASES}")
def next_release_id(spark, sf_dir):
    from tidemark.operators import releases

    return releases.next_id(_releases(spark))


def _releases(spark):
    return spark.createDataFrame([("r1", "ready", False), ("r2", "ready", False), ("r3", "failed", False), ("r9", "ready", True), ("r10", "ready", False), ("r11", "building", False)], "id string, status string, is_current boolean")


@query("""with c as (select conv_id, turn, role, text, row_number() over (partition by conv_id, turn order by role, text) as z from conversations) select role, count(*) as n, sum(coalesce(length(text), 0))::bigint as chars, count(*) filter (where role not in ('user', 'assistant')) as outside from c group by 1""")
def run_stats(spark, sf_dir):
    """Counters of a run by role, and the roles outside the allowed set."""
    c = tables.table(spark, sf_dir, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("chars"), F.count_if(~F.col("role").isin("user", "assistant")).alias("outside"))


@query("with c as (select conv_id, list_distinct(list(role)) as roles from conversations group by 1) select conv_id, len(list_filter(roles, lambda x: x not in ('user', 'assistant'))) = 0 as inside, len(roles)::bigint as roles from c")
def citation_subset(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return c.select("conv_id", (F.size(F.array_except("r", F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("inside"), F.size("r").cast("long").alias("roles"))


@query(f"""with {_DL} select round(avg(abs(quality - toxic)), 9) as mean_delta, count(*) filter (where quality <> toxic) as flips, count(*) filter (where quality = toxic) as agree, round(avg(quality), 9) as hit_rate from dl""")
def agreement(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return d.agg(
        F.round(F.avg(F.abs(F.col("quality") - F.col("toxic"))), 9).alias("mean_delta"), F.count_if(F.col("quality") != F.col("toxic")).alias("flips"), F.count_if(F.col("quality") == F.col("toxic")).alias("agree"), F.round(F.avg("quality"), 9).alias("hit_rate")
    )


@query("""with s as (select doc_id, case when doc_id % 11 = 3 then null when doc_id % 4 = 0 then 'eligible' else 'not_a_round' end as outcome from documents), l as (select max(doc_id) as last from s where outcome is not null)
 select coalesce(outcome, 'unscreened') as outcome, count(*) as n, min(doc_id) as first_rank from s, l where doc_id <= last group by 1""")
def screening(spark, sf_dir):
    """Outcomes of a screening in seeded order up to its last screened rank; what lies unscreened before it is a gap."""
    rank = F.col("doc_id")
    outcome = F.when(rank % 11 == 3, None).when(rank % 4 == 0, "eligible").otherwise("not_a_round")
    s = tables.table(spark, sf_dir, "documents").select("doc_id", outcome.alias("outcome"))
    last = s.where("outcome is not null").agg(F.max("doc_id").alias("last")).select("last").scalar()
    upto = s.where(rank <= last)
    return upto.groupBy(F.coalesce("outcome", F.lit("unscreened")).alias("outcome")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_rank"))
