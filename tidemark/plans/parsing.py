"""Parser and display queries over texts written from the tables; the SQL states what must be read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import records, text
from tidemark.plans.catalogue import query
from tidemark.sources import gazette, tables


def _part(spark, sf_dir):
    p = tables.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").cast("string").alias("n"), (F.col("p_size") + 10).cast("string").alias("more"), (F.col("p_size") % 4).alias("q"))
    return p


@query("""select p_partkey, case p_size % 4 when 0 then p_size + 10 when 1 then p_size + 10 when 2 then p_size + 10 end::bigint as shares_after, case p_size % 4 when 0 then p_size when 1 then 5 when 2 then p_size end::bigint as shares_before from part""")
def share_statements(spark, sf_dir):
    """Shares after and before: bracketed, stated several times, split in French, or of participation capital alone."""
    said = (
        F.when(F.col("q") == 0, F.concat(F.lit("Aktien neu: "), "more", F.lit(" Namenaktien zu CHF 1.00 [bisher: "), "n", F.lit(" Namenaktien zu CHF 1.00].")))
        .when(F.col("q") == 1, F.concat(F.lit("Aktien neu: 7 Namenaktien zu CHF 1.00 [bisher: 5 Namenaktien zu CHF 1.00]. Danach Aktien neu: "), "more", F.lit(" Namenaktien zu CHF 1.00 [bisher: 7 Namenaktien zu CHF 1.00].")))
        .when(F.col("q") == 2, F.concat(F.lit("Les "), "n", F.lit(" actions de CHF 100 sont transformées en "), "more", F.lit(" actions de CHF 10.")))
        .otherwise(F.concat(F.lit("Aktien neu: "), "n", F.lit(" Partizipationsscheine zu CHF 1.00.")))
    )
    language = F.when(F.col("q") == 2, "fr").otherwise("de")
    told = _part(spark, sf_dir).select("p_partkey", gazette.share_segments(said, language).alias("s"))
    total = lambda c: F.aggregate(gazette.share_classes(c), F.lit(0).cast("long"), lambda a, x: a + x["count"])
    return told.select("p_partkey", total(F.col("s.after")).alias("shares_after"), total(F.col("s.before")).alias("shares_before"))


@query("select p_partkey, case p_size % 4 when 0 then p_size + p_size + 10 when 1 then p_size + 1000 end::bigint as issued from part")
def issued_count(spark, sf_dir):
    """Issued shares summed over classes, or as a bare count; quotas are none."""
    said = (
        F.when(F.col("q") == 0, F.concat(F.lit("Augmentation par l'émission de "), "n", F.lit(" actions nominatives de CHF 10.00 et "), "more", F.lit(" actions privilégiées de CHF 1.00, entièrement libérées.")))
        .when(F.col("q") == 1, F.concat(F.lit("Erhöhung durch Ausgabe von 1’"), F.lpad("n", 3, "0"), F.lit(" Namenaktien, voll liberiert.")))
        .when(F.col("q") == 2, F.concat(F.lit("par l'émission de "), "n", F.lit(" parts sociales.")))
        .otherwise(F.lit("Ohne Ausgabe."))
    )
    return _part(spark, sf_dir).select("p_partkey", gazette.issued_shares(said).alias("issued"))


@query("select p_partkey, case when p_size % 4 = 0 then case when p_size < 20 then 'mixed' else 'set_off' end when p_size % 4 = 1 then 'conditional_capital' when p_size % 4 = 2 then 'cash' else 'in_kind' end as contribution from part")
def contribution_kinds(spark, sf_dir):
    """A set-off for fewer shares than the twenty issued leaves cash; an adopted clause issues nothing."""
    said = (
        F.when(F.col("q") == 0, F.concat(F.lit("Verrechnung einer Forderung, wofür "), "n", F.lit(" Namenaktien ausgegeben werden.")))
        .when(F.col("q") == 1, F.lit("Erhöhung aus bedingtem Kapital. Statuten angepasst."))
        .when(F.col("q") == 2, F.lit("Eine Klausel zur Ausgabe aus bedingtem Kapital wurde eingeführt. Erhöhung."))
        .otherwise(F.lit("Sacheinlage von Maschinen."))
    )
    return _part(spark, sf_dir).select("p_partkey", gazette.contribution(said, F.lit(20)).alias("contribution"))


@query("select p_partkey, case p_size % 4 when 0 then 'CHF' when 1 then 'EUR' end as before from part")
def currency_change(spark, sf_dir):
    """The former currency from the classes before, or from French prose; null where the classes agree or nothing is said."""
    item = lambda cur: F.concat(F.lit("5 Namenaktien zu "), F.lit(cur), F.lit(" 1.00"))
    before = F.when(F.col("q").isin(0, 2), item("CHF"))
    after = F.when(F.col("q") == 0, item("USD")).when(F.col("q") == 2, item("CHF"))
    said = F.when(F.col("q") == 1, "La monnaie du capital-actions de EUR 100 a été convertie en CHF.").otherwise("Kapital.")
    told = _part(spark, sf_dir).select("p_partkey", said.alias("said"), gazette.share_classes(before).alias("b"), gazette.share_classes(after).alias("a"))
    return told.select("p_partkey", gazette.currency_before(F.col("said"), F.col("b"), F.col("a")).alias("before"))


@query("select p_partkey, p_size % 6 in (0, 2, 4) as news from part")
def round_news(spark, sf_dir):
    """Titles that can confirm a round; words of any script are whole."""
    k = F.col("p_size") % 6
    title = (
        F.when(k == 0, F.concat(F.lit("Nova "), "n", F.lit(" lève CHF 2m"))).when(k == 1, "Börsengang der Nova").when(k == 2, "Nova übernimmt Alt und sichert Finanzierungsrunde, Kapitalerhöhung")
        .when(k == 3, "Nova übernimmt Alt").when(k == 4, "Nova Preiselbeeren raises").otherwise("Prêt pour Nova")
    )
    return _part(spark, sf_dir).select("p_partkey", text.round_news(title).alias("news"))


@query("""select p_partkey, case p_size % 4 when 0 then 'likely,confirmed' when 1 then 'undecided' when 2 then 'likely,confirmed,undecided,increased' else 'likely,confirmed,increased' end as picked, case p_size % 4 when 1 then 'undecided' when 2 then 'all' when 3 then 'likely,confirmed,increased' end as parameter,
 case p_size % 4 when 0 then 'likely financings or confirmed rounds' when 1 then 'undecided increases' when 2 then 'likely financings, confirmed rounds, undecided increases or other capital increases' else 'likely financings, confirmed rounds or other capital increases' end as phrase from part""")
def feed_filters(spark, sf_dir):
    """A multi-valued parameter to groups, its canonical form and its phrase."""
    raw = F.when(F.col("q") == 1, F.array(F.lit("undecided"), F.lit("other"))).when(F.col("q") == 2, F.array(F.lit("all"))).when(F.col("q") == 3, F.array(F.lit("increased,confirmed"), F.lit("likely")))
    told = _part(spark, sf_dir).select("p_partkey", records.feed_groups(raw).alias("g"))
    return told.select("p_partkey", F.array_join("g", ",").alias("picked"), records.feed_parameter(F.col("g")).alias("parameter"), records.feed_phrase(F.col("g")).alias("phrase"))


@query("""select p_partkey, 'CHF 1’' || lpad(p_size::varchar, 3, '0') || case when p_size % 2 = 0 then '' else '.50' end as money, case when p_size % 2 = 0 then '0.025' else '1’000' end as nominal, printf('%.1f%%', round(p_size / 8.0, 1)) as share, case when p_size % 2 = 0 then 'refused' else '-5.10' end as guarded from part""")
def display_forms(spark, sf_dir):
    """Money, nominals with fractions of a cent, shares; an amount with three decimals is refused."""
    odd = F.col("p_size") % 2 != 0
    return _part(spark, sf_dir).select(
        "p_partkey", text.display_money(F.concat(F.lit("01"), F.lpad("n", 3, "0"), F.when(odd, ".5").otherwise(".00")), F.lit("CHF")).alias("money"), text.display_nominal(F.when(odd, "1000").otherwise("0.0250")).alias("nominal"),
        text.display_share(F.col("p_size") / 800).alias("share"), F.coalesce(text.display_decimal(F.when(odd, "-5.10").otherwise("1.234")), F.lit("refused")).alias("guarded"),
    )


@query("""select p_partkey, case p_size % 4 when 0 then '/feed' when 1 then '/feed?asof=2024-01-20&s=all' when 2 then '/feed?s=a%2Cb' else '/feed?asof=1' end as href, case when p_size % 4 = 3 then '/feed?asof=1' end as redirect from part""")
def canonical_links(spark, sf_dir):
    """Links that spell only what differs from the default, and redirects where a request spells more."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value"))
    q = F.col("q")
    canonical = F.when(q == 0, F.array(pair("asof", None), pair("s", ""))).when(q == 1, F.array(pair("asof", "2024-01-20"), pair("s", "all"))).when(q == 2, F.array(pair("asof", None), pair("s", "a,b"))).otherwise(F.array(pair("asof", "1"), pair("s", None)))
    asked = F.when(q == 0, F.slice(F.array(pair("a", "b")), 1, 0)).when(q == 1, F.array(pair("s", "all"), pair("asof", "2024-01-20"))).when(q == 2, F.array(pair("s", "a,b"))).otherwise(F.array(pair("asof", "1"), pair("s", "likely")))
    return _part(spark, sf_dir).select("p_partkey", records.href(F.lit("/feed"), canonical).alias("href"), records.redirect(F.lit("/feed"), asked, canonical).alias("redirect"))


@query("""with t as (select p_partkey, case p_size % 7 when 0 then 'set_off' when 1 then 'in_kind' when 2 then 'conditional_capital' when 3 then 'cash' when 4 then 'mixed' else 'other' end as c from part)
 select c as contribution, case c when 'set_off' then 'conversion_only' when 'in_kind' then 'restructuring' when 'conditional_capital' then 'esop' when 'other' then 'unknown' else 'new_equity' end as transaction, count(*) as n from t group by 1, 2""")
def label_mapping(spark, sf_dir):
    """Development labels from how an increase was paid."""
    k = F.col("p_size") % 7
    c = F.when(k == 0, "set_off").when(k == 1, "in_kind").when(k == 2, "conditional_capital").when(k == 3, "cash").when(k == 4, "mixed").otherwise("other")
    return tables.table(spark, sf_dir, "part").select(c.alias("contribution")).groupBy("contribution").agg(F.count("*").alias("n")).select("contribution", records.transaction(F.col("contribution")).alias("transaction"), "n")
