"""Calendar expressions: days, weeks, holidays, ages. All are column expressions over dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_iso_date(text: Column) -> Column:
    """Zero-padded and a day of the calendar; never null."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull(), F.lit(False))


def iso_weekday(day: Column) -> Column:
    """0 is Monday."""
    return F.weekday(day)


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_end(day: Column, as_of: Column) -> Column:
    """Sunday, or the as-of day if that comes first."""
    return F.least(F.date_add(week_start(day), 6), as_of)


def resolve_as_of(raw: Column, first: Column, last: Column) -> tuple[Column, Column]:
    """(the day to use, a notice or null): a missing or malformed day is the last, others are clamped."""
    given = F.when(is_iso_date(raw), raw.try_cast("date"))
    day = F.coalesce(F.least(F.greatest(given, first), last), last)
    notice = F.when(raw.isNull(), None).when(given.isNull(), "malformed").when(given < first, "before").when(given > last, "after")
    return day, notice


def zurich_day(instant: Column) -> Column:
    """The local calendar day of a UTC instant."""
    return F.from_utc_timestamp(instant, "Europe/Zurich").cast("date")


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday, from the moon's age on the calendar's fixed cycle."""
    golden, century = year % 19, F.floor(year / 100)
    # epact of the year, corrected for dropped leap days and for the moon's drift
    skipped, drift = century - F.floor(century / 4), F.floor((8 * century + 13) / 25)
    moon = F.pmod(19 * golden + skipped - drift + 15, F.lit(30))
    late = (moon == 29) | ((moon == 28) & (golden > 10))
    full = F.date_add(F.make_date(year, F.lit(3), F.lit(21)), (moon - late.cast("int")).cast("int"))
    # the Sunday after the paschal full moon
    return F.date_add(full, 7 - F.pmod(F.weekday(full) + 1, F.lit(7)))


#: Fixed values: (month, day) and days from Easter of the gazette's holidays.
FIXED_HOLIDAYS = ((1, 1), (1, 2), (8, 1), (12, 25), (12, 26))
EASTER_HOLIDAYS = (-2, 1, 39, 50)


def holidays(years: DataFrame) -> DataFrame:
    """(year, holiday) of a table of years; nine a year."""
    y = F.col("year")
    days = [F.make_date(y, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS] + [F.date_add(easter(y), k) for k in EASTER_HOLIDAYS]
    return years.select("year", F.explode(F.array(*days)).alias("holiday"))


def missing_days(present: DataFrame, first: str, last: str, with_holidays: bool = True) -> DataFrame:
    """Weekdays, less holidays, from ``first`` to ``last`` that ``present`` (day) lacks: a calendar anti join."""
    spark = present.sparkSession
    span = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")).where(F.weekday("day") < 5)
    if with_holidays:
        years = span.select(F.year("day").alias("year")).distinct()
        span = span.join(holidays(years).select(F.col("holiday").alias("day")), "day", "left_anti")
    return span.join(present.select("day").distinct(), "day", "left_anti")


def whole_years(start: Column, end: Column) -> Column:
    """Birthdays passed, by month and day."""
    return F.year(end) - F.year(start) - (F.date_format(end, "MM-dd") < F.date_format(start, "MM-dd")).cast("int")


def age_bucket(founded: Column, day: Column) -> Column:
    years = whole_years(founded, day)
    return F.when(founded.isNull() | (day < founded), "unknown").when(years < 2, "under_2").when(years < 6, "2_to_6").otherwise("over_6")


def legal_day(statute: Column, journal: Column, published: Column) -> Column:
    """The statute's day, else the journal's; not after publication nor ten years before it, else publication."""
    day = F.coalesce(statute, journal, published)
    return F.when(day.between(F.date_sub(published, 3650), published), day).otherwise(published)


def display(day: Column) -> Column:
    return F.date_format(day, "d MMM yyyy")


def display_range(start: Column, end: Column) -> Column:
    """One day, or a range without what both share."""
    same_month = F.date_format(start, "yyyyMM") == F.date_format(end, "yyyyMM")
    left = F.when(same_month, F.date_format(start, "d")).when(F.year(start) == F.year(end), F.date_format(start, "d MMM")).otherwise(display(start))
    return F.when(start == end, display(end)).otherwise(F.concat(left, F.lit(" – "), display(end)))


#: Month names in three languages.
MONTHS = (
    ("januar", "janvier", "gennaio"), ("februar", "février", "febbraio"), ("märz", "mars", "marzo"), ("april", "avril", "aprile"), ("mai", "mai", "maggio"), ("juni", "juin", "giugno"),
    ("juli", "juillet", "luglio"), ("august", "août", "agosto"), ("september", "septembre", "settembre"), ("oktober", "octobre", "ottobre"), ("november", "novembre", "novembre"), ("dezember", "décembre", "dicembre"),
)


def swiss_day(text: Column) -> Column:
    """The first day in prose, as 29.09.2026 or in words; null if there is none or it is no day."""
    dotted, worded = r"(\d{1,2})\.(\d{1,2})\.(\d{4})", r"(\d{1,2})(?:er)?\.? (\p{L}+) (\d{4})"
    month = F.lit(None).cast("string")
    name = F.lower(F.regexp_extract(text, worded, 2))
    for k, names in enumerate(MONTHS):
        month = F.when(name.isin(*names), F.lit(f"{k + 1:02d}")).otherwise(month)
    two = lambda c: F.lpad(c, 2, "0")
    by_dots = F.concat_ws("-", F.regexp_extract(text, dotted, 3), two(F.regexp_extract(text, dotted, 2)), two(F.regexp_extract(text, dotted, 1)))
    by_words = F.concat(F.regexp_extract(text, worded, 3), F.lit("-"), month, F.lit("-"), two(F.regexp_extract(text, worded, 1)))
    at_dots, at_words = F.regexp_instr(text, F.lit(dotted)), F.regexp_instr(text, F.lit(worded))
    iso = F.when((at_dots > 0) & ((at_words == 0) | (at_dots <= at_words)), by_dots).when(at_words > 0, by_words)
    return iso.try_cast("date")
