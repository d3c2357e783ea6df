"""Redaction queries: texts written from the tables, told again without names, and the gates before publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import clauses, redaction
from tidemark.operators import derivation, names, releases
from tidemark.plans.catalogue import query
from tidemark.sources import gazette, tables

#: SQL: the two words of a part's name with capitals, in both orders, as persons of the texts.
_PERSONS = """p as (select p_partkey, p_size, p_size::varchar as n, p_name, upper(substr(a, 1, 1)) || substr(a, 2) as a, upper(substr(b, 1, 1)) || substr(b, 2) as b
 from (select p_partkey, p_size, p_name, split_part(p_name, ' ', 1) as a, split_part(p_name, ' ', 2) as b from part))"""


def _persons(spark, sf_dir):
    """(p_partkey, p_size, n, p_name, a, b): a and b are the words of the part's name, as a person's first and last name."""
    part = tables.table(spark, sf_dir, "part")
    word = lambda k: F.initcap(F.split_part("p_name", F.lit(" "), F.lit(k)))
    return part.select("p_partkey", "p_size", F.col("p_size").cast("string").alias("n"), "p_name", word(1).alias("a"), word(2).alias("b"))


def _said(*parts):
    """Columns by name, other strings as they are."""
    return F.concat(*[F.col(x) if x in ("a", "b", "n", "p_name") else F.lit(x) for x in parts])


def _cases(k, *cases):
    """The case whose place is k; the last one for all others."""
    out = cases[-1]
    for at in range(len(cases) - 2, -1, -1):
        out = F.when(k == at, cases[at]).otherwise(out)
    return out


@query(f"""with {_PERSONS} select p_partkey, case p_size % 4 when 0 then 'Anteile gezeichnet von <PERSON_1>, c/o <PERSON_2>.' when 1 then 'Cession par la gérante <PERSON_1> le ' || n || ' mai.'
 when 2 then 'Post c/o <PERSON_3> und gezeichnet von <PERSON_2> für die Aktionärin <PERSON_1>.' else 'Gezeichnet wird ' || p_name || '.' end as masked from p""")
def mask_persons(spark, sf_dir):
    """Persons' numbers count pattern by pattern, so a later lead earlier in the text has a higher number."""
    told = _cases(
        F.col("p_size") % 4, _said("Anteile gezeichnet von ", "a", " ", "b", ", c/o ", "b", " ", "a", "."), _said("Cession par la gérante ", "a", " ", "b", " le ", "n", " mai."),
        _said("Post c/o ", "b", " ", "a", " und gezeichnet von ", "a", " ", "b", " für die Aktionärin ", "b", " ", "a", "."), _said("Gezeichnet wird ", "p_name", "."),
    )
    return _persons(spark, sf_dir).select("p_partkey", redaction.numbered(told).alias("masked"))


@query("""with w as (select p_partkey, 'Zeta' || p_partkey as z from part) select p_partkey, array_to_string(list_transform(list_sort(list_transform([z || ' Swiss Labs AG', z || ' Swiss Labs', z || ' Laboratoires SA', z || ' Laboratoires', 'Laboratoires', z],
 lambda t: lpad((1000 - length(t))::varchar, 4, '0') || t)), lambda x: substr(x, 5)), '|') as terms from w""")
def name_terms(spark, sf_dir):
    z = F.concat(F.lit("Zeta"), F.col("p_partkey").cast("string"))
    told = F.array(F.concat(z, F.lit(" Swiss Labs AG ("), z, F.lit(" Laboratoires SA)")))
    return _persons(spark, sf_dir).select("p_partkey", F.array_join(redaction.name_terms(told), "|").alias("terms"))


@query(f"""with {_PERSONS} select p_partkey, '[company] ([company]), [uid], [address], [town], in [town], siehe [link] oder [link]; ' || n || ' Aktien gezeichnet von [person]; Betazeta' || lower(b) || ' bleibt.' as redacted from p""")
def redact_record(spark, sf_dir):
    """A record without its company, persons, seat, identifier, links and address."""
    told = F.concat(
        _said("Zeta", "b", " Labs AG ("), F.upper(_said("Zeta", "b")), _said("), CHE-123.456.789, Lindenallee 12a, 3000 Thun, in Zug, siehe https://example.org/x oder info@example.com; ", "n", " Aktien gezeichnet von ", "a", " Quandt; Betazeta"), F.lower("b"), F.lit(" bleibt.")
    )
    return _persons(spark, sf_dir).select("p_partkey", redaction.redacted(told, F.array(_said("Zeta", "b", " Labs AG")), F.lit("Zug (ZG)")).alias("redacted"))


_STEP = "'Aktienkapital neu: CHF ' || n || '. Aktien neu: ' || n || ' Namenaktien.'"


@query(f"""with {_PERSONS} select p_partkey, case p_size % 6 when 0 then {_STEP} || ' Kapitalerhöhung in bar.' when 1 then {_STEP} || ' Kapitalerhöhung gezeichnet von [name removed].' when 2 then null when 3 then null when 4 then {_STEP} else null end as excerpt,
 {_STEP} || case p_size % 6 when 0 then ' Kapitalerhöhung in bar.' when 1 then ' Kapitalerhöhung gezeichnet von <PERSON_1>.' when 2 then ' Kapitalerhöhung durch Herr ' || a || ' ' || b || '.' when 3 then ' Kapitalerhöhung: ' || b || ', ' || a || ', aus Ulm.' when 4 then '' else ' Kapitalerhöhung, soci ' || a || ' ' || b || '.' end as company_text from p""")
def excerpts(spark, sf_dir):
    """The passage behind a step, from the clauses that the splitter finds; withheld where a rule of personal data is met or a name may be left."""
    last = _cases(
        F.col("p_size") % 6, F.lit(" Kapitalerhöhung in bar."), _said(" Kapitalerhöhung gezeichnet von ", "a", " ", "b", "."), _said(" Kapitalerhöhung durch Herr ", "a", " ", "b", "."),
        _said(" Kapitalerhöhung: ", "b", ", ", "a", ", aus Ulm."), _said(" Kapitalerhöhung: Dr. ", "b", " zeichnet."), _said(" Kapitalerhöhung, soci ", "a", " ", "b", "."),
    )
    told = _persons(spark, sf_dir).select("p_partkey", F.concat(_said("Aktienkapital neu: CHF ", "n", ". Aktien neu: ", "n", " Namenaktien."), last).alias("body"))
    told = told.withColumn("c", clauses.clauses(F.col("body")))
    return told.select("p_partkey", redaction.excerpt(F.col("body"), F.col("c")).alias("excerpt"), redaction.company_text(F.col("c")).alias("company_text"))


@query(f"""with {_PERSONS}, list as (select a, b, row_number() over (order by a, b) as n from (select distinct a, b from p))
 select p_partkey, '<PERSON_' || list.n || '> und <PERSON_' || list.n || '>, ' || p.a || ' ' || p.b || 's; /team/person-' || list.n || '-x' as scrubbed from p join list using (a, b)""")
def scrub_names(spark, sf_dir):
    """All persons of the table as one list: their names replaced in texts and links, where no letter touches them."""
    p = _persons(spark, sf_dir)
    told = p.select("p_partkey", F.concat(_said("a", " ", "b", " und "), F.upper(_said("a", "  ", "b")), _said(", ", "a", " ", "b", "s; /team/"), F.lower(_said("a", "-", "b")), F.lit("-x")).alias("scrubbed"))
    return names.scrub(told, "scrubbed", _list(p.select(_said("a", " ", "b").alias("name"))))


def _list(named):
    """(n, name): a list of names, numbered in their order."""
    from pyspark.sql import Window

    return named.distinct().select(F.row_number().over(Window.orderBy("name")).cast("long").alias("n"), "name")


@query(f"""with {_PERSONS} select p_partkey, concat_ws('|', a || ' ' || b, b || ' ' || a, b || ' ' || a, a || ' ' || b) as persons from p""")
def registered_persons(spark, sf_dir):
    told = _said("Neu: ", "b", ", ", "a", ", von Ulm; gelöscht: ", "a", ", ", "b", ", in Genf; ", "p_name", ", vendu.")
    return _persons(spark, sf_dir).select("p_partkey", F.array_join(redaction.registered_persons(told), "|").alias("persons"))


# Clauses of the documents. The SQL protects abbreviations' stops, then cuts after the others.
_WS = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_KIND_SQL = (
    f"(case when i = 1 and regexp_matches(c, {_quoted(clauses.UID)}) then case when regexp_matches(c, {_quoted(clauses.CORRECTION)}) then 'correction' else 'header' end "
    + " ".join(f"when regexp_matches(c, {_quoted(p)}) then 'person'" for p, _ in clauses.PERSON)
    + " "
    + " ".join(f"when regexp_matches(c, {_quoted(p)}) then '{k}'" for k, p, _ in clauses.KINDS)
    + " else 'other' end)"
)


@query(f"""with t as (select doc_id, text, string_split(replace(regexp_replace(regexp_replace(replace(text, chr(1), ' '), '(^|[^A-Za-z0-9_])({clauses.SHORT})\\.', '\\1\\2' || chr(2), 'g'), '\\.({_WS}+)({clauses.OPENS.replace("'", "''").replace(clauses.SPACE, _WS)})', '.' || chr(1) || '\\1\\2', 'g'), chr(2), '.'), chr(1)) as p from documents where text is not null),
 c as (select doc_id, unnest(p) as piece, generate_subscripts(p, 1) as i from t),
 s as (select doc_id, i, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) + case when i = 1 then 0 else length(piece) - length(regexp_replace(piece, '^{_WS}+', '')) end as begun,
 regexp_replace(case when i = 1 then piece else regexp_replace(piece, '^{_WS}+', '') end, '{_WS}+$', '') as c from c)
 select doc_id, count(*)::bigint as clauses, sum(length(c))::bigint as chars, md5(string_agg({_KIND_SQL} || ':' || begun || ':' || (begun + length(c)), ',' order by i)) as places from s where c <> '' group by 1""")
def clause_places(spark, sf_dir):
    """Kind, start and end of every clause of every document, in one pass over each text."""
    told = tables.table(spark, sf_dir, "documents").where("text is not null").select("doc_id", clauses.clauses(F.col("text")).alias("c")).where(F.size("c") > 0)
    place = F.transform("c", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    chars = F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"]))
    return told.select("doc_id", F.size("c").cast("long").alias("clauses"), chars.alias("chars"), F.md5(F.array_join(place, ",")).alias("places"))


#: SQL: a list of names as a table gives one: the first three words of each benchmark item.
_LISTED = "list as (select row_number() over (order by name) as n, name from (select distinct array_to_string(string_split(text, ' ')[1:3], ' ') as name from benchmark))"


def _listed(spark, sf_dir):
    words = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return _list(tables.table(spark, sf_dir, "benchmark").select(words.alias("name")))


@query(f"""with {_LISTED}, cells as (select doc_id, 'text' as cell, text as value from documents union all select doc_id, 'source', source from documents union all select doc_id, 'lang', lang from documents)
 select doc_id, cell, n, (len(string_split(lower(value), lower(name))) - 1)::bigint as hits, (strpos(lower(value), lower(name)) - 1)::bigint as first_at from cells, list where length(name) >= 4 and contains(lower(value), lower(name))""")
def listed_names(spark, sf_dir):
    """Every place in any cell of the documents where a name of a list is, found by one automaton for the list."""
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = names.occurrences(names.cells(docs, "doc_id"), _listed(spark, sf_dir), anywhere=True)
    return found.groupBy("doc_id", "cell", "n").agg(F.count("*").alias("hits"), F.min("start").cast("long").alias("first_at"))


@query(f"""with {_LISTED}, cells as (select doc_id, 'text' as cell, text as value from documents union all select doc_id, 'source', source from documents),
 hits as ({" union all ".join(f"select cell, '{r}' as rule from cells where regexp_matches(value, {_quoted(p)})" for r, p in clauses.PERSONAL.items())}
 union all select cell, 'listed person name' from cells where exists (select 1 from list where length(name) >= 4 and contains(lower(value), lower(name)))) select cell, rule, count(*)::bigint as hits from hits group by 1, 2""")
def publication_gate(spark, sf_dir):
    """What stands against publishing the documents as they are: the five rules and a list of names, over every cell."""
    docs = tables.table(spark, sf_dir, "documents").select("text", "source")
    hits = releases.personal_cells(docs, names=_listed(spark, sf_dir))
    return hits.groupBy("cell", "rule").agg(F.count("*").alias("hits"))


@query(f"""with {_PERSONS} select p_partkey, case p_size % 5 when 0 then 'cash' when 1 then 'cash' when 2 then 'set_off' when 3 then 'in_kind' else 'cash' end as contribution from p""")
def removed_clauses(spark, sf_dir):
    """How an increase was paid where the text tells of removed clauses, of claims that are set off, or of a loss that is."""
    told = _cases(
        F.col("p_size") % 5, _said("Erhöhung um CHF ", "n", ". Die Bestimmung über die Sacheinlage der Firma ", "b", " wurde gestrichen."), _said("Augmentation de CHF ", "n", ". Radiation de la clause d'apport en nature de ", "b", "."),
        _said("Forderungen von ", "b", " in der Höhe von CHF ", "n", " werden zur Verrechnung gebracht."), _said("Sacheinlage von ", "p_name", ". [gestrichen: Verrechnung einer Forderung.]"),
        _said("Forderungen von CHF ", "n", " kommen zur Verrechnung mit dem Bilanzverlust."),
    )
    return _persons(spark, sf_dir).select("p_partkey", gazette.contribution(gazette.active(told)).alias("contribution"))


#: SQL: each customer as an entry of its nation's company: form, capital before and after, purpose, day.
_ENTRIES = """e as (select c_custkey, c_nationkey, date '2024-01-01' + (c_custkey % 90)::int as day, 100000 + (c_custkey % 7) * 500 as after, c_nationkey % 5 <> 0 as ag, case when c_mktsegment = 'MACHINERY' then 'tech_purpose' end as hit from customer)"""


@query(f"""with {_ENTRIES} select case when not ag then 'capital_increased' else 'abstain' end as tier, case when not ag then 'not_ag' end as reject_reason, coalesce(hit, '') as rules, count(*)::bigint as n, count(distinct c_nationkey)::bigint as companies,
 (select count(*) from customer)::bigint as publications from e where after > 100000 and day between date '2024-01-15' and date '2024-03-15' group by 1, 2, 3""")
def release_tiers(spark, sf_dir):
    """A release from gazette XML, written of the customers: parsed once, folded, judged by the rules, with no answers of a scorer yet."""
    n, key = F.col("c_nationkey"), F.col("c_custkey")
    part = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string") if not isinstance(value, str) else F.lit(value), F.lit(f"</{name}>"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (key % 90).cast("int"))
    company = lambda form: F.concat(F.lit("<company>"), part("name", F.concat(F.lit("Company "), n)), part("uid", F.format_string("CHE-100.000.%03d", n)), part("legalForm", form), F.lit("</company>"))
    form = F.when(n % 5 != 0, "0106").otherwise("0107")
    capital = lambda c: F.concat(F.lit("<capital>"), part("nominal", c), F.lit("</capital>"))
    xml = F.concat(
        F.lit("<entry><meta>"), part("id", key), part("subRubric", "HR02"), part("language", "de"), part("publicationNumber", key), part("publicationDate", day), F.lit("</meta><content>"), part("publicationText", F.concat(F.lit("Kapital von Company "), n, F.lit(": neu."))), F.lit("<commonsNew>"), company(form),
        part("purpose", F.when(F.col("c_mktsegment") == "MACHINERY", "Entwicklung von Software.").otherwise("Handel.")), capital(100000 + (key % 7) * 500), F.lit("</commonsNew><commonsActual>"), company(form), capital(F.lit(100000)), F.lit("</commonsActual></content></entry>"),
    )
    # a small file of customers makes many documents, so they are dealt before they are written out
    dealt = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    raw = dealt.select(xml.alias("xml"))
    parsed = derivation.parse(raw, releases.scratch(spark, "parsed"))
    answers = spark.createDataFrame([], "input_hash string, model string, prompt string, score double, error string")
    told = derivation.derive(parsed, derivation.Plan(snapshot="2024-03-15", backfill_start="2024-01-15"), answers).rows
    judged = told["assessments"].join(told["events"].select("event_id", "uid").hint("merge"), "event_id")  # events pack so well on disk that they would be broadcast
    return judged.groupBy("tier", "reject_reason", F.concat_ws("|", "rule_hits").alias("rules")).agg(F.count("*").alias("n"), F.count_distinct("uid").alias("companies")).withColumn("publications", F.lit(parsed.counters()["publications"]).cast("long"))
