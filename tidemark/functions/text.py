"""Text expressions: markup, names, identifiers, amounts and their display."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named entities and what they stand for.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
_ENTITY = r"(?i)&(#x[0-9a-f]+|#[0-9]+|[a-z]+);"
#: Legal-form words.
LEGAL_WORDS = r"\b(?:ag|sa|s\.a\.|gmbh|sarl|sagl|ltd|inc|llc|plc|holding|in liquidation)\b"
#: Currencies.
CURRENCIES = ("CHF", "EUR", "USD", "GBP")


def decode_entities(text: Column) -> Column:
    """Named and numeric entities in one pass, so what a decoded one makes up with its neighbours stays; unknown ones, and numbers of no character, stay too."""

    def decoded(entity: Column) -> Column:
        digits = F.substring(entity, 2, 12)
        number = F.when(F.lower(entity).startswith("#x"), F.conv(F.substring(entity, 3, 12), 16, 10)).otherwise(digits).try_cast("long")
        character = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        real = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF) & (F.length(entity) <= 10)
        named = reduce(lambda out, e: F.when(F.lower(entity) == e[0], e[1]).otherwise(out), ENTITIES.items(), F.lit(None).cast("string"))
        return F.coalesce(F.when(entity.startswith("#"), F.when(real, character)).otherwise(named), F.concat(F.lit("&"), entity, F.lit(";")))

    parts, entities = F.split(text, _ENTITY), F.regexp_extract_all(text, F.lit(_ENTITY), 1)
    both = F.zip_with(parts, F.transform(entities, decoded), lambda p, e: F.concat(p, F.coalesce(e, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(both, "")).otherwise(text)


@cache
def bare_letters() -> tuple[str, str, dict[str, str]]:
    """Of all characters but ASCII: (those that stand for one of a name's characters, and then the accents, which go; what they stand for; those that stand for several).

    Made from the decompositions of the Unicode database: what is left of a character without its accents, in lower case,
    where that holds a letter a to z, a digit, a dot or an ampersand.
    """
    accents = [chr(c) for c in range(0x300, 0x370)]
    one, several = {}, {}
    for c in (chr(k) for k in range(0x80, 0x30000) if not 0xD800 <= k <= 0xDFFF):
        left = "".join(x for x in unicodedata.normalize("NFKD", c) if x not in accents).lower()
        if any(x in "abcdefghijklmnopqrstuvwxyz0123456789.&" for x in left):
            (one if len(left) == 1 else several)[c] = left
    return "".join(one) + "".join(accents), "".join(one.values()), several


def bare(text: Column) -> Column:
    """Lower case, decomposed, without accents. Few texts have characters that stand for several; only those are looked at one by one."""
    known, plain, several = bare_letters()
    told = F.lower(F.translate(text, known, plain))
    one_by_one = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    spread = F.array_join(F.transform(F.split(told, ""), lambda c: F.coalesce(F.element_at(one_by_one, c), c)), "")
    return F.when(text.rlike("[" + "".join(several) + "]"), spread).otherwise(told)


def strip_tags(html: Column) -> Column:
    lines = F.regexp_replace(html, r"(?i)<br\s*/?>|</p>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(lines, r"<[^>]*>", ""), r"[ \t]+", " "))


def uid(raw: Column) -> Column:
    """CHE and nine digits, or null."""
    bare = F.upper(F.regexp_replace(raw, r"[\s.\-]", ""))
    return F.when(bare.rlike(r"^CHE[0-9]{9}$"), bare)


def display_uid(canonical: Column) -> Column:
    return F.regexp_replace(canonical, r"^(CHE)(\d{3})(\d{3})(\d{3})$", "$1-$2.$3.$4")


def normal_name(name: Column) -> Column:
    """Bare lower-case words: letters a to z, digits and dots."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(bare(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9.]+", " "), r" +", " "))


def name_stem(name: Column) -> Column:
    """The normal name without legal-form words."""
    return F.trim(F.regexp_replace(F.regexp_replace(normal_name(name), LEGAL_WORDS, " "), " +", " "))


def contains_words(text: Column, words: Column) -> Column:
    space = F.lit(" ")
    return (F.length(words) >= 3) & F.concat(space, text, space).contains(F.concat(space, words, space))


# An amount of money in a title, the currency before or after it, and what the words for currencies mean.
_BEFORE = r"(CHF|USD|EUR|GBP|US\$|\$|€|£)\s?([0-9]+(?:[.,][0-9]+)?)\s?(million|mio\.?|m|billion|bn)(?![A-Za-z0-9_])"
_AFTER = r"([0-9]+(?:[.,][0-9]+)?)\s?(million|mio\.?|billion|bn)\s?(?:in\s+)?(CHF|francs|swiss francs|USD|dollars|EUR|euros)"
CURRENCY_WORDS = {"chf": "CHF", "francs": "CHF", "swiss francs": "CHF", "usd": "USD", "us$": "USD", "$": "USD", "dollars": "USD", "eur": "EUR", "€": "EUR", "euros": "EUR", "gbp": "GBP", "£": "GBP"}


def stated_amount(title: Column) -> tuple[Column, Column]:
    """(amount, currency) of the first amount like ``CHF 4.5 million``, ``US$ 3m`` or ``2 mio francs``; null where none is stated."""
    take = lambda k: F.nullif(F.regexp_extract(title, f"(?i){_BEFORE}|{_AFTER}", k), F.lit(""))
    word = F.lower(F.coalesce(take(1), take(6)))
    currency = F.get(F.filter(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in CURRENCY_WORDS.items()]), lambda x: x["w"] == word), F.lit(0))["c"]
    number, unit = F.coalesce(take(2), take(4)), F.lower(F.coalesce(take(3), take(5)))
    factor = F.when(unit.startswith("b"), F.lit(1_000_000_000)).when(unit.startswith("m"), F.lit(1_000_000))
    return F.round(F.replace(number, F.lit(","), F.lit(".")).cast("double") * factor).cast("long"), currency


# Words of titles that are never a round, that are one only if money came in, and that say it did.
NO_ROUND = r"grants?|awards?|prizes?|preis|prix|loans?|prêts?|darlehen|kredit|crédit|ipo|spac|go(?:es|ing)? public|listing|börsengang|liquidation"
TAKEOVER = r"acqui\p{L}*|übernimmt|übernahme|rachat|rachète|racheté|kauft|merger|majority|mehrheits\p{L}*|majoritaire"
MONEY_IN = r"rais\p{L}*|secur\p{L}*|funding|financing|round|series [a-f]|seed|investors?|investment|finanzierung\p{L}*|finanziert|kapitalerhöhung|levée|lève|financement|tour de table"


def whole_words(body: Column, alternatives: str) -> Column:
    """Whether a word of the text is one of the alternatives, in any case; letters and digits of any script make words."""
    return body.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{alternatives})(?![\p{{L}}\p{{N}}])")


def round_news(title: Column) -> Column:
    """Whether a title can confirm a round: no grant, loan or listing, and of takeovers those where money came in."""
    return ~whole_words(title, NO_ROUND) & (~whole_words(title, TAKEOVER) | whole_words(title, MONEY_IN))


def stage(title: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(title, r"(?i)\b(pre-seed|seed|series [a-f]|bridge|growth)\b", 1)), F.lit(""))


def clip(text: Column, n: int) -> Column:
    """At most ``n`` characters, back to a word's end, with a mark."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, n), r"\s+\S*\z", ""), F.lit(" …")))


def first_sentence(text: Column) -> Column:
    """Up to a full stop or semicolon before a capital."""
    return F.get(F.split(text, r"(?<=[.;])\s+(?=[A-ZÄÖÜÉÈ])"), F.lit(0))


def plain_number(text: Column) -> Column:
    """Without group marks; a decimal comma is a point; no idle zeros."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[’'\s]", ""), r",(\d{1,2})$", ".$1")
    return F.when(bare.contains("."), F.regexp_replace(F.regexp_replace(bare, r"0+$", ""), r"\.$", "")).otherwise(bare)


def grouped(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\B(?=(\d{3})+(?!\d))", "’")


def display_amount(amount: Column) -> Column:
    """Grouped thousands; cents only where there are any."""
    whole = F.floor(F.abs(amount)).cast("long")
    cents = F.round((F.abs(amount) - whole) * 100).cast("int")
    sign = F.when(amount < 0, "-").otherwise("")
    return F.concat(sign, grouped(whole), F.when(cents > 0, F.concat(F.lit("."), F.lpad(cents.cast("string"), 2, "0"))).otherwise(""))


def display_decimal(number: Column) -> Column:
    """A decimal text with grouped thousands, cents only where there are any. Null if it is no decimal or has more than two decimals."""
    n = F.trim(number)
    whole, cents = F.regexp_replace(F.regexp_extract(n, r"^-?(\d+)", 1), r"^0+(?=\d)", ""), F.regexp_extract(n, r"\.(\d{1,2})0*$", 1)
    shown = F.concat(F.regexp_extract(n, r"^(-?)", 1), grouped(whole), F.when(cents.rlike("[1-9]"), F.concat(F.lit("."), F.rpad(cents, 2, "0"))).otherwise(""))
    return F.when(n.rlike(r"^-?\d+(?:\.\d{0,2}0*)?$") & ~n.rlike(r"\.$"), shown)


def display_money(number: Column, currency: Column) -> Column:
    return F.concat(currency, F.lit(" "), display_decimal(number))


def display_nominal(number: Column) -> Column:
    """As an amount, but with every decimal of fractions of a cent."""
    n, fine = F.trim(number), r"^(\d+)\.(\d{2}\d*?[1-9])0*$"
    return F.when(n.rlike(fine), F.concat(display_decimal(F.regexp_extract(n, fine, 1)), F.lit("."), F.regexp_extract(n, fine, 2))).otherwise(display_decimal(n))


def display_share(fraction: Column) -> Column:
    """0.1234 as 12.3%."""
    return F.format_string("%.1f%%", fraction * 100)


def compact(amount: Column) -> Column:
    """1.2M, 120k or 850."""
    short = lambda x: F.regexp_replace(F.format_string("%.1f", x), r"\.0$", "")
    n = amount.cast("double")
    return F.when(n >= 1e6, F.concat(short(n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(F.round(n / 1e3).cast("long").cast("string"), F.lit("k"))).otherwise(F.round(n).cast("long").cast("string"))


def https_only(url: Column) -> Column:
    return F.when(F.try_parse_url(url, F.lit("PROTOCOL")) == "https", url)


def redacted(text: Column) -> Column:
    """E-mail addresses, links and long digit runs replaced by their kind."""
    mail = F.when(text.contains("@"), F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]")).otherwise(text)
    link = F.regexp_replace(mail, r"https?://[^ \n]+", "[LINK]")
    return F.regexp_replace(link, r"[0-9]{7,}", "[NUMBER]")
