"""Calendar helpers on DATE columns (month starts, month arithmetic)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(c: Column | str) -> Column:
    """First day of the month as DATE (``trunc`` keeps DATE; ``date_trunc`` would give TIMESTAMP)."""
    return F.trunc(F.col(c) if isinstance(c, str) else c, "MM")


def as_of_month(as_of: dt.date) -> Column:
    return F.trunc(F.lit(as_of), "MM")


def month_index(c: Column | str) -> Column:
    """Months since year 0: ``year * 12 + month``; differences count month boundaries."""
    col = F.col(c) if isinstance(c, str) else c
    return F.year(col) * 12 + F.month(col)


def months_between_starts(start: Column, end: Column) -> Column:
    """Number of month boundaries crossed from ``start`` to ``end`` (SQL ``date_diff('month', ...)``).

    Spark's ``months_between``/``timestampdiff`` count whole elapsed months, which
    differs for dates that are not month starts; this is the calendar count.
    """
    return month_index(end) - month_index(start)


def months_into_period(c: Column, unit: str) -> Column:
    """0-based month position inside its quarter (``unit='QUARTER'``) or year (``'YEAR'``)."""
    return months_between_starts(F.trunc(c, unit), c)
