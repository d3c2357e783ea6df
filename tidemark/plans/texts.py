"""Text queries over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans.catalogue import query
from tidemark.sources import tables


def _docs(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", "text")


@query("select doc_id, len(string_split(regexp_replace(text, '\\. +([A-Z])', '.' || chr(1) || '\\1', 'g'), chr(1)))::bigint as clauses, length(text)::bigint as last_end from documents where text is not null")
def clause_split_counts(spark, sf_dir):
    cut = F.split(F.regexp_replace("text", r"\. +([A-Z])", ".\x01$1"), "\x01")
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", F.size(cut).cast("long").alias("clauses"), F.length("text").cast("long").alias("last_end"))


@query("select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+', '[EMAIL]', 'g'), 'https?://[^ \\n]+', '[LINK]', 'g'), '[0-9]{7,}', '[NUMBER]', 'g')) as redacted from documents")
def redact_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.redacted(F.col("text"))).alias("redacted"))


_GATE = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9-]+", "uid": "CHE-[0-9]{3}", "phone": "\\+[0-9][0-9 ().-]{8,}", "number": "[0-9]{9,}"}


@query("select rule, cell, count(*) as hits from (select c.cell, r.rule, c.value, r.re from (select 'text' as cell, text as value from documents union all select 'source', source from documents) c, (values " + ", ".join(f"('{k}', '{v}')" for k, v in _GATE.items()) + ") r(rule, re)) where regexp_matches(value, re) group by 1, 2")
def person_data_gate(spark, sf_dir):
    """One aggregate over the table, a count for each rule and cell. An address is looked for only where there is an at sign."""
    wanted = lambda c, k, v: (F.col(c).contains("@") if k == "email" else F.lit(True)) & F.col(c).rlike(v)
    counts = tables.table(spark, sf_dir, "documents").agg(*[F.count_if(wanted(c, k, v)).alias(f"{c}_{k}") for c in ("text", "source") for k, v in _GATE.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(c).alias("cell"), F.col(f"{c}_{k}").alias("hits")) for c in ("text", "source") for k in _GATE])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("hits > 0")


@query("""select page_id, len(regexp_extract_all(html, 'href="([^"]*)"', 1))::bigint as links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::bigint as kinds, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' ') as targets, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title from pages""")
def html_links(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return tables.table(spark, sf_dir, "pages").select(
        "page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("kinds"), F.array_join(F.array_sort(F.array_distinct(links)), " ").alias("targets"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title")
    )


@query("""select page_id, md5(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<br */?>|</p>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'))) as body from pages""")
def html_text(spark, sf_dir):
    return tables.table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(text.decode_entities(text.strip_tags(F.col("html"))))).alias("body"))


@query("""select page_id, len(regexp_extract_all(html, '<li>'))::bigint as listed, len(regexp_extract_all(html, '<li><a href="[^"]*">'))::bigint as parsed, len(regexp_extract_all(html, '<li>')) = len(regexp_extract_all(html, '<li><a href="[^"]*">')) as complete from pages""")
def listing_completeness(spark, sf_dir):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), 0)).cast("long")
    told = tables.table(spark, sf_dir, "pages").select("page_id", n("<li>").alias("listed"), n('<li><a href="[^"]*">').alias("parsed"))
    return told.withColumn("complete", F.col("listed") == F.col("parsed"))


@query("select p_partkey, regexp_matches(lower(p_name || ' ' || p_type), '(^| )(steel|brass)( |$)') as excluded, not regexp_matches(lower(p_name || ' ' || p_type), '(^| )(steel|brass)( |$)') and p_size > 5 as news from part")
def title_filter(spark, sf_dir):
    words = F.lower(F.concat("p_name", F.lit(" "), "p_type"))
    out = words.rlike("(^| )(steel|brass)( |$)")
    return tables.table(spark, sf_dir, "part").select("p_partkey", out.alias("excluded"), (~out & (F.col("p_size") > 5)).alias("news"))


@query("select doc_id, case when length(text) <= 80 then text else regexp_replace(substr(text, 1, 80), '[ \\n\\t\\r]+[^ \\n\\t\\r]*$', '') || ' …' end as clipped from documents where text is not null")
def clip_text(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


@query("select doc_id, md5(regexp_replace(replace(text, ',', '[') , '\\[[^\\].]*\\.', ' ', 'g')) as active from documents")
def former_text_strip(spark, sf_dir):
    """Bracketed former text goes; commas play the opening bracket and full stops the closing one."""
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(F.replace("text", F.lit(","), F.lit("[")), r"\[[^\].]*\.", " ")).alias("active"))


@query("select event_id, case when event_id % 3 = 0 then null else cast(json_extract_string(props, '$.k') as int) end as k, event_id % 3 <> 0 as valid from events")
def json_guard(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.substring("props", 2, 100)).otherwise(F.col("props"))
    parsed = tables.table(spark, sf_dir, "events").select("event_id", F.try_parse_json(raw).alias("v"))
    return parsed.select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"), F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)).alias("valid"))


@query("select p_partkey, cast(p_size as bigint) * 3 as units, 'CHF' as currency, p_size || '.5' as nominal from part")
def share_items(spark, sf_dir):
    """Class statements written from the part table and read back, item by item."""
    size = F.col("p_size").cast("string")
    said = F.concat(F.lit("Aktien neu: "), (F.col("p_size") * 3).cast("string"), F.lit(" Namenaktien zu CHF "), size, F.lit(".50 und 10 Partizipationsscheine zu CHF 1.00."))
    told = tables.table(spark, sf_dir, "part").select("p_partkey", said.alias("said"))
    pattern = F.lit(r"(\d[\d’']*)\s+([^\d,;]*?aktien)\s+zu\s+(CHF|EUR|USD|GBP)\s+([\d’'.]*\d)")
    part = lambda k: F.regexp_extract_all("said", pattern, k)
    items = told.select("p_partkey", F.explode(F.arrays_zip(part(1).alias("n"), part(3).alias("c"), part(4).alias("v"))).alias("x"))
    return items.select("p_partkey", text.plain_number(F.col("x.n")).cast("long").alias("units"), F.col("x.c").alias("currency"), text.plain_number(F.col("x.v")).alias("nominal"))


@query("select p_partkey, p_name || ' ' || p_brand as name, lower(p_type) as label, case when p_size <= 10 then 'small' when p_size is null then 'unknown' else cast(p_size as varchar) end as size_label from part")
def feature_struct(spark, sf_dir):
    s = F.struct(F.concat("p_name", F.lit(" "), "p_brand").alias("name"), F.lower("p_type").alias("label"), F.when(F.col("p_size") <= 10, "small").otherwise(F.coalesce(F.col("p_size").cast("string"), F.lit("unknown"))).alias("size_label"))
    return tables.table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.*")
