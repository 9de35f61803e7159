"""Dates of listings.  "Now" is always given, so that results can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _back(as_of: Column, days: Column) -> Column:
    return F.date_sub(as_of, days.cast("int"))


def relative_date(text: Column, as_of: Column) -> Column:
    """"3 days ago", "2 weeks ago", "today": a week has 7 and a month 30 days; null if unclear."""
    low = F.lower(F.trim(text))
    amount = F.regexp_extract(low, r"(\d+)", 1).try_cast("int")
    unit = F.when(low.contains("week"), 7).when(low.contains("month"), 30).when(low.contains("day"), 1)
    return F.when(low.rlike("today|just posted|just now|minute|hour"), as_of).when(amount.isNotNull(), _back(as_of, amount * unit))


def label_or_created(label: Column, created: Column, as_of: Column) -> Column:
    """A label with an age, or else a time of creation in seconds or milliseconds."""
    low = F.lower(F.coalesce(label, F.lit("")))
    amount = F.regexp_extract(low, r"(\d+)\s*(day|week|month)", 1).try_cast("int")
    unit = F.regexp_extract(low, r"(\d+)\s*(day|week|month)", 2)
    days = amount * F.when(unit == "week", 7).when(unit == "month", 30).otherwise(1)
    seconds = F.when(created > 10_000_000_000, created / 1000).otherwise(created)
    return (
        F.when(low.rlike("today|just now|hour"), as_of)
        .when(amount.isNotNull(), _back(as_of, days))
        .when(created != 0, F.to_date(F.timestamp_seconds(seconds)))
    )


# Formats tried in this order.
FORMATS = (
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
)


def published_date(text: Column) -> Column:
    """A date in one of FORMATS, with or without "Published:"; deadlines are no such date."""
    bare = F.trim(F.replace(text, F.lit("Published:"), F.lit("")))
    tries = [F.when(bare.rlike(p), F.to_date(F.try_to_timestamp(bare, F.lit(f)))) for p, f in FORMATS]
    return F.when(~F.lower(text).contains("deadline"), F.coalesce(*tries))


def epoch_millis_date(value: Column) -> Column:
    return F.to_date(F.timestamp_millis(value.cast("bigint")))


def iso_date(text: Column) -> Column:
    """The day of an ISO time stamp, as written in its own time zone."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.substring(text, 1, 10).try_cast("date"))


def plain_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def days_ago(age: Column, as_of: Column) -> Column:
    return _back(as_of, age)


def posted_within(date_posted: Column, hours: int, as_of: Column) -> Column:
    """The offline form of a filter on age, in whole days."""
    return date_posted >= F.date_sub(as_of, max(-(-hours // 24), 1))
