"""Lenient date parsing and date repair."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# shape of a date text and the pattern that reads it; ISO forms need none
OTHER_FORMATS = [
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
]


def lenient_date(value: Column) -> Column:
    """Date of an ISO date, timestamp or common date text; null if unreadable.

    Formats are tried by shape, as a failed parse costs far more than a test.
    """
    text = F.trim(value)
    other = [
        F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(pattern)))) for shape, pattern in OTHER_FORMATS
    ]
    return F.coalesce(text.try_cast("date"), *other)


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def valid_from(start: Column, observed: Column) -> Column:
    return F.coalesce(start, observed)


def valid_until(end: Column, start: Column, days: int = 7) -> Column:
    return F.coalesce(end, F.date_add(start, days))


def repaired_end(end: Column, observed: Column, missing_days: int = 7) -> Column:
    """An end before the observation becomes a week; a missing one a set window."""
    return (
        F.when(end < observed, F.date_add(observed, 7))
        .when(end.isNull(), F.date_add(observed, missing_days))
        .otherwise(end)
    )


def repaired_day(observed: Column, as_of: Column) -> Column:
    return F.least(observed, as_of)


def weeks_since(later: Column, earlier: Column) -> Column:
    return F.floor(F.datediff(later, earlier) / 7).cast("bigint")
