"""One spelling of a nested value: JSON whose keys are in order at every depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_text(text: Column) -> Column:
    """A JSON text with its keys in order, escapes and numbers in one spelling; null where it is no JSON.

    A variant holds its keys in order, so reading and writing it is enough, however deep the value is.
    """
    return F.to_json(F.try_parse_json(text))


def json_value(value: Column) -> Column:
    """The same of a struct, map or array; null fields are kept."""
    return json_text(F.to_json(value, {"ignoreNullFields": "false"}))


def fingerprint(value: Column) -> Column:
    """SHA-256 of the one spelling: equal for equal values, whatever the order of their fields."""
    return F.sha2(json_value(value), 256)
