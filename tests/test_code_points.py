"""Entities and names over every character, against Python's own tables."""

import re
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import text


def normal(s):
    s = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFKD", s)).lower().replace("&", " and ")
    return re.sub(r"\s+", " ", re.sub("[^a-z0-9.]+", " ", s)).strip()


def test_names_of_every_character(spark):
    """Each character of the basic plane, and of letter-like ones beyond it, between two letters."""
    every = [f"A{chr(k)}b" for k in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]]
    got = spark.createDataFrame([(s,) for s in every], "s string").select("s", text.normal_name(F.col("s")).alias("n")).collect()
    # what lower case makes of a character before and after it is taken apart may differ from Python's in no case
    assert [(r.s, r.n) for r in got if r.n != normal(r.s)] == [] and len(got) == len(every)


def test_entities_of_every_character(spark):
    some = [*range(1, 0x3000, 7), 0xD7FF, 0xE000, 0xFFFD, 0x1F600, 0x10FFFF]
    rows = [(f"a&#{k};b&#x{k:X};", f"a{chr(k)}b{chr(k)}") for k in some]
    rows += [
        ("&amp;lt; &#38;lt; &amp;#39;", "&lt; &lt; &#39;"), ("&AMP;&Quot;&nbsp;&apos;", "&\" '"), ("&unknown; &; &#; &#x; & x;", "&unknown; &; &#; &#x; & x;"), ("&#xD800; &#1114112; &#99999999999999999999;", "&#xD800; &#1114112; &#99999999999999999999;"),
        ("", ""), (None, None), ("no entity", "no entity"), ("&lt;", "<"), ("&#X41;", "A"),
    ]
    got = spark.createDataFrame(rows, "s string, want string").select("s", "want", text.decode_entities(F.col("s")).alias("got")).collect()
    assert [(r.s, r.want, r.got) for r in got if r.want != r.got] == []


def test_amounts_in_their_wordings(spark):
    rows = [
        ("raises US$ 3 million", 3_000_000, "USD"), ("sichert 2 mio CHF", 2_000_000, "CHF"), ("closes € 5m round", 5_000_000, "EUR"), ("1,5 Mio. Swiss francs", 1_500_000, "CHF"), ("£2bn", 2_000_000_000, "GBP"), ("3 million in dollars", 3_000_000, "USD"),
        ("5 metres", None, None), ("CHF 4 meters", None, None), (None, None, None), ("2 mio EUR, then CHF 3 million", 2_000_000, "EUR"),
    ]
    amount, currency = text.stated_amount(F.col("s"))
    got = spark.createDataFrame(rows, "s string, a long, c string").select("s", "a", "c", amount.alias("x"), currency.alias("y")).collect()
    assert [tuple(r) for r in got if (r.a, r.c) != (r.x, r.y)] == []
    stages = spark.createDataFrame([("Series F closed",), ("pre-seed",)], "s string").select(text.stage(F.col("s"))).collect()
    assert [r[0] for r in stages] == ["series f", "pre-seed"]
    stems = spark.createDataFrame([("Acme Holding AG in Liquidation",), ("Acme LLC & Cie plc",)], "s string").select(text.name_stem(F.col("s"))).collect()
    assert [r[0] for r in stems] == ["acme", "acme and cie"]
