"""Folds over histories, rules and share arithmetic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import domain, text
from tidemark.operators import history as ops
from tidemark.plans.catalogue import query
from tidemark.plans.feed import EV
from tidemark.sources import tables


@query(f"""with {EV}, w as (select event_id, user_id, type,
 last_value(case when type = 'purchase' then amount end ignore nulls) over b as prev_amount, coalesce(last_value(case when type = 'click' then k < 80 end ignore nulls) over b, false) as in_force,
 coalesce(max(case when type = 'view' and k < 5 then 1 else 0 end) over b = 1, false) as converted, first_value(case when type = 'signup' then published_at end ignore nulls) over (partition by user_id order by published_at, event_id rows between unbounded preceding and current row) as founded
 from ev window b as (partition by user_id order by published_at, event_id rows between unbounded preceding and 1 preceding)) select * from w""")
def fold_context(spark, sf_dir):
    e = tables.events(spark, sf_dir)
    on = lambda t, c: F.when(F.col("type") == t, c)
    out = ops.fold(e, "user_id", ["published_at", "event_id"], on("purchase", F.col("amount")), on("click", F.col("k") < 80), (F.col("type") == "view") & (F.col("k") < 5), F.col("type") == "signup", "published_at")
    return out.select("event_id", "user_id", "type", "prev_amount", "in_force", "converted", "founded")


@query("""with o as (select *, cast(o_orderdate as date) as day from orders) select o_orderkey, list_aggregate(list_sort(list_distinct(list(o_orderpriority) over (partition by o_custkey order by day range between unbounded preceding and current row))), 'string_agg', ',') as names from o""")
def names_so_far(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return tables.orders(spark, sf_dir).select("o_orderkey", F.array_join(F.array_sort(F.collect_set("o_orderpriority").over(w)), ",").alias("names"))


@query("""with o as (select *, cast(o_orderdate as date) as day from orders), l as (select *, first_value(o_orderstatus) over (partition by o_custkey order by day desc, o_orderkey desc) as last_s from o),
 b as (select *, sum(case when o_orderstatus <> last_s then 1 else 0 end) over (partition by o_custkey order by day desc, o_orderkey desc rows between unbounded preceding and current row) as broken from l)
 select o_custkey, count(*) as steps, min(day) as since, any_value(last_s) as status from b where broken = 0 group by 1""")
def currency_run(spark, sf_dir):
    run = ops.trailing_run(tables.orders(spark, sf_dir), "o_custkey", "o_orderstatus", "day", "o_orderkey")
    return run.groupBy("o_custkey").agg(F.count("*").alias("steps"), F.min("day").alias("since"), F.max("o_orderstatus").alias("status"))


@query("""with p as (select l_orderkey, l_returnflag as part, sum(cast(l_extendedprice as decimal(18,2))) as v from lineitem group by 1, 2), t as (select l_orderkey, sum(v) as total from p group by 1),
 ok as (select t.l_orderkey, t.total, abs(t.total - cast(o.o_totalprice as decimal(18,2))) <= cast(o.o_totalprice as decimal(18,2)) * 0.5 as fits from t join orders o on o.o_orderkey = t.l_orderkey)
 select ok.l_orderkey, case when fits then part else 'all' end as part, cast(case when fits then v else total end as decimal(38,2)) as value from ok join p using (l_orderkey) where fits or part = (select min(part) from p p2 where p2.l_orderkey = ok.l_orderkey)""")
def class_parts(spark, sf_dir):
    """An order's parts where they add up to its total within a tolerance, else one part of all."""
    p = tables.lines(spark, sf_dir).groupBy("l_orderkey", F.col("l_returnflag").alias("part")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v"))
    per = p.groupBy("l_orderkey").agg(F.sum("v").alias("total"), F.collect_list(F.struct("part", "v")).alias("parts"))
    o = tables.orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))
    fits = F.abs(F.col("total") - F.col("stated")) <= F.col("stated") * F.lit("0.5").cast("decimal(2,1)")
    parts = F.when(fits, F.col("parts")).otherwise(F.array(F.struct(F.lit("all").alias("part"), F.col("total").alias("v"))))
    # an order has at most one part for each flag
    return per.join(o, "l_orderkey").select("l_orderkey", F.explode(parts).alias("x")).select("l_orderkey", "x.part", F.col("x.v").cast("decimal(38,2)").alias("value"))


@query("""with q as (select l_orderkey, cast(sum(l_quantity) as bigint) as n, max(l_returnflag) as f from lineitem group by 1), o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day from orders),
 s as (select o_orderkey, n as after, f, lag(n) over (partition by o_custkey order by day, o_orderkey) as before from o join q on o_orderkey = l_orderkey),
 r as (select *, case when f = 'R' and after % 7 = 0 then 'conversion to an AG' when after % 11 = 0 then 'shares cancelled and reissued' when f = 'A' and after < before then 'capital reduction' when after % 13 = 0 then 'nominal value per share changed' when before is null then 'share counts not published' when after <= before or after <= 0 then 'no new shares' end as reason from s)
 select o_orderkey, reason, case when reason is null then after - before end as new_shares, round(case when reason is null then (after - before)::double / after end, 9) as fraction from r""")
def share_issuance(spark, sf_dir):
    q = tables.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("after"), F.max("l_returnflag").alias("f"))
    o = tables.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "day").join(q, F.col("o_orderkey") == F.col("l_orderkey"))
    s = o.withColumn("before", F.lag("after").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")))
    a, b, f = F.col("after"), F.col("before"), F.col("f")
    reason, new, fraction = domain.issuance(b, a, (f == "R") & (a % 7 == 0), a % 11 == 0, (f == "A") & (a < b), a % 13 == 0)
    return s.select("o_orderkey", reason.alias("reason"), new.alias("new_shares"), F.round(fraction, 9).alias("fraction"))


_RULES = {r.id: r.weight for r in domain.RULES}
_COND = {
    "odd_amount_small_nominal": "p_size <= 10 and amount > 0 and amount % 1000 >= 0.005",
    "young_company": "p_size < 25",
    "tech_purpose": "p_type ilike '%steel%' or p_type ilike '%eco%'",
    "new_preferred_class": "l_returnflag = 'R'",
    "round_amount_holding": "amount % 100 < 0.005 and amount > 0",
    "esop_sized_increment": "l_quantity < 2",
    "set_off_only": "l_linestatus = 'F' and l_linenumber = 2",
    "in_kind_only": "l_linenumber = 5",
    "capital_reduction": "l_quantity > 48",
}


def _featured(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    return tables.lines(spark, sf_dir).withColumn("amount", F.col("l_extendedprice").cast("decimal(18,2)")).join(p, F.col("l_partkey") == F.col("p_partkey"))


_HITS = "list_filter([" + ", ".join(f"case when {c} then '{k}' end" for k, c in _COND.items()) + "], lambda x: x is not null)"
_TOTAL = " + ".join(f"case when {c} then {_RULES[k]} else 0.0 end" for k, c in _COND.items())
_FEATURED = "f as (select *, cast(l_extendedprice as decimal(18,2)) as amount from lineitem join part on l_partkey = p_partkey)"


def _conditions():
    return {k: F.expr(c.replace("%steel%", "%steel%")) for k, c in _COND.items()}


@query(f"with {_FEATURED} select l_orderkey, l_linenumber, l_partkey, coalesce(list_aggregate({_HITS}, 'string_agg', '|'), '') as hits, cast({_TOTAL} as double) as score, not (l_quantity > 48) and cast({_TOTAL} as double) >= 1 as rules_positive from f")
def rule_hits(spark, sf_dir):
    f, c = _featured(spark, sf_dir), _conditions()
    told = f.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", domain.hit_list(c).alias("hits"), domain.score(c).alias("score"))
    return told.select("l_orderkey", "l_linenumber", "l_partkey", "hits", "score", ((F.col("l_quantity") <= 48) & (F.col("score") >= domain.RULES_THRESHOLD)).alias("rules_positive"))


@query(f"with {_FEATURED}, h as (select unnest({_HITS}) as rule, l_returnflag = 'R' as good from f) select rule, count(*) as fired, count(*) filter (where good) as positives from h group by 1")
def rule_stats(spark, sf_dir):
    """One aggregate over the lines, two counts for each rule; rules that never fired are left out."""
    c, good = _conditions(), F.col("l_returnflag") == "R"
    counts = _featured(spark, sf_dir).agg(*[F.struct(F.count_if(x).alias("fired"), F.count_if(x & good).alias("positives")).alias(k) for k, x in c.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"{k}.fired").alias("fired"), F.col(f"{k}.positives").alias("positives")) for k in c])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("fired > 0")


@query("select '" + domain.fingerprint() + "' as fingerprint, " + str(len(domain.RULES)) + "::bigint as rules, cast(" + str(max(abs(r.weight) for r in domain.RULES)) + " as double) as widest")
def fingerprint(spark, sf_dir):
    rules = spark.createDataFrame([(k, f"{r.id}:{r.kind}:{r.weight:g}", r.weight) for k, r in enumerate(domain.RULES)], "k int, line string, weight double")
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "|")
    return rules.agg(ordered.alias("fingerprint"), F.count("*").alias("rules"), F.max(F.abs("weight")).alias("widest"))


@query("""with c as (select l_orderkey, max(l_discount >= 0.09) as high, max(l_discount >= 0.05) as low, min(l_tax) as s from lineitem group by 1), t as (select o_orderkey, case when s >= 0.06 then 'likely_financing' when s >= 0.035 then 'abstain' when s is not null then 'capital_increased' end as tier, coalesce(high, false) as high, coalesce(low, false) as low from orders left join c on o_orderkey = l_orderkey)
 select o_orderkey, tier, case when high then case when tier = 'likely_financing' then 'confirmed' else 'confirmed_missed' end when low then 'possible_confirmation' else coalesce(tier, 'not_assessed') end as status from t""")
def status_derive(spark, sf_dir):
    c = tables.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.max(F.col("l_discount") >= 0.09).alias("high"), F.max(F.col("l_discount") >= 0.05).alias("low"), F.min("l_tax").alias("s"))
    t = tables.orders(spark, sf_dir).join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    tier = F.when(F.col("s") >= 0.06, "likely_financing").when(F.col("s") >= 0.035, "abstain").when(F.col("s").isNotNull(), "capital_increased")
    return t.select("o_orderkey", tier.alias("tier"), F.coalesce("high", F.lit(False)).alias("high"), F.coalesce("low", F.lit(False)).alias("low")).select("o_orderkey", "tier", domain.status(F.col("tier"), F.col("high"), F.col("low")).alias("status"))


@query("""with f as (select l_orderkey, list_sort(list_distinct(list(l_returnflag))) as flags from lineitem group by 1), o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, flags from orders join f on o_orderkey = l_orderkey),
 b as (select *, lag(flags) over (partition by o_custkey order by day, o_orderkey) as prev from o)
 select o_orderkey, array_to_string(flags, ',') as now_flags, coalesce(flags = prev, false) as same, coalesce(len(list_filter(flags, lambda x: not list_contains(prev, x))) > 0, false) as gained,
 coalesce(len(list_filter(flags, lambda x: not list_contains(prev, x))) > 0 and len(list_filter(prev, lambda x: not list_contains(flags, x))) > 0, false) as changed from b""")
def distinct_sets(spark, sf_dir):
    f = tables.lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    o = tables.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "day").join(f, F.col("o_orderkey") == F.col("l_orderkey"))
    b = o.withColumn("prev", F.lag("flags").over(Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")))
    no = lambda c: F.coalesce(c, F.lit(False))
    more, less = F.size(F.array_except("flags", "prev")) > 0, F.size(F.array_except("prev", "flags")) > 0
    known = F.col("prev").isNotNull()
    return b.select("o_orderkey", F.array_join("flags", ",").alias("now_flags"), no(F.col("flags") == F.col("prev")).alias("same"), no(known & more).alias("gained"), no(known & more & less).alias("changed"))


@query("""with o as (select *, cast(o_orderdate as date) as day from orders), x as (select o_orderkey, o_custkey, day, case when o_orderkey % 3 = 0 then o_orderpriority end as p from o)
 select o_custkey, (select p from x y where y.o_custkey = x.o_custkey and p is not null order by day desc, o_orderkey desc limit 1) as attribute, count(distinct p) as kinds from x group by 1""")
def attribute_carry(spark, sf_dir):
    o = tables.orders(spark, sf_dir).withColumn("p", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")))
    return o.groupBy("o_custkey").agg(F.max_by("p", F.when(F.col("p").isNotNull(), F.struct("day", "o_orderkey"))).alias("attribute"), F.count_distinct("p").alias("kinds"))


@query("""with x as (select o_custkey, o_orderpriority as cls, min((cast(o_orderdate as date), o_orderkey)) as first from orders group by 1, 2) select o_custkey, cls, row_number() over (partition by o_custkey order by cls like '1%' or cls like '2%', first) as place from x""")
def class_order(spark, sf_dir):
    x = tables.orders(spark, sf_dir).groupBy("o_custkey", F.col("o_orderpriority").alias("cls")).agg(F.min(F.struct("day", "o_orderkey")).alias("first"))
    later = F.col("cls").startswith("1") | F.col("cls").startswith("2")
    return x.select("o_custkey", "cls", F.row_number().over(Window.partitionBy("o_custkey").orderBy(later, "first")).cast("long").alias("place"))


@query("""select o_orderkey, case when a >= 1000000 then regexp_replace(printf('%.1f', a / 1000000), '\\.0$', '') || 'M' when a >= 1000 then cast(cast(round(a / 1000) as bigint) as varchar) || 'k' else cast(cast(round(a) as bigint) as varchar) end as compact, replace(printf('%,d', cast(floor(a) as bigint)), ',', '’') as grouped from (select o_orderkey, floor(o_totalprice) as a from orders)""")
def format_amounts(spark, sf_dir):
    a = F.floor("o_totalprice")
    return tables.orders(spark, sf_dir).select("o_orderkey", text.compact(a).alias("compact"), text.grouped(a.cast("long")).alias("grouped"))
