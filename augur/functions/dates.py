"""Dates as sources give them: ISO texts, epoch seconds or milliseconds. Session time zone UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from augur.functions.text import strip

_LAST = 253402300799  # last second of the year 9999


def is_iso_date(text: Column) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def parse_epoch(number: Column) -> Column:
    """Over 1e12: milliseconds, else seconds; the UTC date, null outside of years 1 to 9999."""
    n = number.try_cast("double")
    seconds = F.when(n > 1e12, n / 1000).otherwise(n)
    return F.when(seconds.between(-62135596800, _LAST), F.to_date(F.timestamp_seconds(F.floor(seconds))))


def parse_iso_date(text: Column) -> Column:
    """UTC date of an ISO date or date-time (with zone, or UTC where it has none); otherwise of
    its first ten characters; null for blanks and ``N/A``."""
    return parse_stripped_date(strip(text))


def parse_stripped_date(t: Column) -> Column:
    """:func:`parse_iso_date` of a text without white space around it."""
    full = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}:?\d{2})?$"
    zoned = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[zZ]$", "+00:00"), ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    head = F.when(F.substring(t, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    value = F.when(t.rlike(full), F.coalesce(F.to_date(zoned.try_cast("timestamp")), head)).otherwise(head)
    return F.when((F.length(t) > 0) & (F.lower(t) != "n/a"), value)


def parse_any_date(value: Column) -> Column:
    """Of a JSON scalar read as text: a plain number is an epoch, whatever its length, all else a text."""
    number = strip(value).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$")
    return F.when(number, parse_epoch(value)).otherwise(parse_iso_date(value))


def month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def stratify_key(date: Column, mode: str) -> Column:
    if mode == "none":
        return F.lit("all")
    if mode == "resolved_month":
        return month(date)
    raise ValueError(f"unknown stratification {mode!r}")
