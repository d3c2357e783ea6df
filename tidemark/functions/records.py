"""Column expressions for records and their display: regions, legal forms, links, week steps, metric lines, term lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Region codes and short names of legal forms.
CANTONS = ("AG", "AI", "AR", "BE", "BL", "BS", "FR", "GE", "GL", "GR", "JU", "LU", "NE", "NW", "OW", "SG", "SH", "SO", "SZ", "TG", "TI", "UR", "VD", "VS", "ZG", "ZH")
LEGAL_FORMS = {"0106": "AG", "0107": "GmbH", "0108": "Genossenschaft"}


def canton(code: Column) -> Column:
    """A valid region code in upper case, else null."""
    upper = F.upper(F.trim(code))
    return F.when(upper.isin(*CANTONS), upper)


def legal_form(code: Column) -> Column:
    """The short name of a legal form's code, else the code."""
    names = F.create_map(*[F.lit(x) for pair in LEGAL_FORMS.items() for x in pair])
    return F.coalesce(F.element_at(names, code), code)


def step_week(week: Column, weeks: int, first: Column, last: Column) -> Column:
    """The week so many weeks on, if it lies between the first and the last, else null."""
    to = F.date_add(week, 7 * weeks)
    return F.when((to >= first) & (to <= last), to)


def chunks(first: Column, last: Column, days: int) -> Column:
    """Ranges (start, end) of at most ``days`` days that cover first to last."""
    starts = F.sequence(first, last, F.expr(f"interval {days} days"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.date_add(s, days - 1), last).alias("end")))


def metric_line(hit: Column, of: Column, noun: str) -> Column:
    """'3 of 4 documents (75.0%)', with the noun in the singular for one, and without a share for none."""
    share = F.format_string(" (%.1f%%)", F.round(100.0 * hit / of, 1))
    return F.concat(hit.cast("string"), F.lit(" of "), of.cast("string"), F.when(of == 1, f" {noun}").otherwise(f" {noun}s"), F.when(of == 0, "").otherwise(share))


def longest_first(terms: Column) -> Column:
    """Distinct terms, longer ones first, equal lengths in order: as they must be replaced."""
    keyed = F.array_sort(F.transform(F.array_distinct(terms), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(keyed, lambda x: x["t"])


# Groups of the feed, in their order, with their words; the first two are the default.
FEED_GROUPS = {"likely": "likely financings", "confirmed": "confirmed rounds", "undecided": "undecided increases", "increased": "other capital increases"}
FEED_DEFAULT = ("likely", "confirmed")
# What a contribution says of a transaction.
TRANSACTIONS = {"set_off": "conversion_only", "in_kind": "restructuring", "conditional_capital": "esop", "cash": "new_equity", "mixed": "new_equity"}


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def feed_groups(raw: Column) -> Column:
    """Groups that a parameter (array of comma lists, may be null) asks for, in order; unknown ones are dropped, none means the default."""
    asked = F.flatten(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda v: F.split(v, ",")))
    picked = F.when(F.array_contains(asked, "all"), _words(FEED_GROUPS)).otherwise(F.filter(_words(FEED_GROUPS), lambda g: F.array_contains(asked, g)))
    return F.when(F.size(picked) > 0, picked).otherwise(_words(FEED_DEFAULT))


def feed_parameter(groups: Column) -> Column:
    """The canonical parameter: null for the default, ``all``, or the groups in order."""
    inorder = F.filter(_words(FEED_GROUPS), lambda g: F.array_contains(groups, g))
    return F.when(inorder == _words(FEED_DEFAULT), None).when(F.size(inorder) == len(FEED_GROUPS), "all").otherwise(F.array_join(inorder, ","))


def feed_phrase(groups: Column, joiner: str = "or") -> Column:
    """``a, b or c`` of the groups' words."""
    names = F.create_map(*[F.lit(x) for pair in FEED_GROUPS.items() for x in pair])
    words = F.transform(F.filter(_words(FEED_GROUPS), lambda g: F.array_contains(groups, g)), lambda g: F.element_at(names, g))
    n = F.size(words)
    return F.when(n < 2, F.coalesce(F.get(words, F.lit(0)), F.lit(""))).otherwise(F.concat_ws(f" {joiner} ", F.array_join(F.slice(words, 1, n - 1), ", "), F.element_at(words, -1)))


def href(path: Column, parameters: Column) -> Column:
    """A link with the parameters (array of (key, value)) that have a value."""
    kept = F.filter(parameters, lambda p: F.coalesce(p["value"], F.lit("")) != "")
    pairs = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&")
    return F.when(F.size(kept) > 0, F.concat(path, F.lit("?"), pairs)).otherwise(path)


def redirect(path: Column, asked: Column, canonical: Column) -> Column:
    """The canonical link if the asked parameters differ from its own in more than their order, else null."""
    spelled = lambda ps: F.array_sort(F.transform(ps, lambda p: F.concat_ws("=", p["key"], F.coalesce(p["value"], F.lit("")))))
    kept = F.filter(canonical, lambda p: F.coalesce(p["value"], F.lit("")) != "")
    return F.when(spelled(asked) != spelled(kept), href(path, canonical))


def transaction(contribution: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in TRANSACTIONS.items() for x in pair])
    return F.coalesce(F.element_at(names, contribution), F.lit("unknown"))
