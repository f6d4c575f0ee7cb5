"""Dates, ages and lifetimes as Column expressions; text that isn't a date becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMATS = ["MM/dd/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy"]


def coerce_timestamp(c: Column) -> Column:
    """ISO dates and times with or without a zone, and a few written forms; never today's date for a word."""
    iso = F.when(c.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(c)))
    written = [F.when(c.rlike(r"^\s*(?:\d{1,2}/|[A-Za-z]+ \d)"), F.try_to_timestamp(F.trim(c), F.lit(f))) for f in _FORMATS]
    return F.coalesce(iso, *written)


def precision(ts: Column) -> Column:
    """DAY for exact midnight UTC, else TIME; null for null."""
    return F.when(ts.isNull(), F.lit(None)).when(F.date_trunc("day", ts) == ts, F.lit("DAY")).otherwise(F.lit("TIME"))


def age_days(ts: Column, now: Column) -> Column:
    """Whole days between dates for DAY precision, else days with a fraction."""
    return F.when(precision(ts) == "DAY", F.datediff(F.to_date(now), F.to_date(ts)).cast("double")).otherwise((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86_400_000_000.0))


def freshness(ts: Column, now: Column, window_hours: Column, max_days: int) -> Column:
    """struct(keep, age_days, reason): reasons STALE, FUTURE_POSTING_DATE, MISSING_POSTING_DATE, UNDATED_WITHIN_SOURCE_WINDOW."""
    age = age_days(ts, now)
    shown = F.greatest(age, F.lit(0.0))
    made = lambda keep, a, reason: F.struct(F.lit(keep).alias("keep"), a.cast("double").alias("age_days"), F.lit(reason).cast("string").alias("reason"))
    none = F.lit(None)
    ahead = F.when(precision(ts) == "DAY", age < -1).otherwise(age < F.lit(-1 / 24))
    undated = F.when(F.coalesce(window_hours <= max_days * 24, F.lit(False)), made(True, none, "UNDATED_WITHIN_SOURCE_WINDOW")).otherwise(made(False, none, "MISSING_POSTING_DATE"))
    return F.when(ts.isNull(), undated).when(ahead, made(False, age, "FUTURE_POSTING_DATE")).when(shown > max_days, made(False, shown, "STALE")).otherwise(made(True, shown, None))


def within_days(ts: Column, now: Column, days: int) -> Column:
    """Whether a cached fact is at most so many days old; false without a date."""
    return F.coalesce(F.unix_micros(now) - F.unix_micros(ts) <= F.lit(days * 86_400_000_000), F.lit(False))


def relative_age(c: Column, now: Column) -> Column:
    """The time that '30m+', '3 days ago', '2w' or 'just posted' means; months count as 30 days."""
    text = F.lower(F.trim(c))
    n = F.try_to_number(F.regexp_extract(text, r"(\d{1,5})", 1), F.lit("99999")).cast("double")
    unit = F.regexp_extract(text, r"\d+\s*\+?\s*(mo|[smhdw])", 1)
    seconds = F.when(unit == "s", n).when(unit == "m", n * 60).when(unit == "h", n * 3600).when(unit == "d", n * 86400).when(unit == "w", n * 604800).when(unit == "mo", n * 2_592_000)
    seconds = F.when(text.rlike(r"just|today|now"), F.lit(0.0)).when(text.contains("yesterday"), F.lit(86400.0)).otherwise(seconds)
    return F.timestamp_micros((F.unix_micros(now) - seconds * 1_000_000).cast("long"))


def window_days(hours: Column) -> Column:
    """The smallest of a source's 7- and 14-day filters that covers so many hours; null beyond."""
    return F.when(hours.isNull() | (hours <= 0), F.lit(None).cast("int")).when(hours <= 168, F.lit(7)).when(hours <= 336, F.lit(14))
