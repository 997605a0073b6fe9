"""Column-level helpers, all built from ``pyspark.sql.functions`` (JVM side)."""

from ledgerline.functions.activity import (
    COUNTERS,
    DAYS_WITH,
    MONTHLY_TOTALS,
    flag,
    row_total,
)
from ledgerline.functions.dates import (
    month_index,
    month_start,
    months_between_starts,
    months_into_period,
)
from ledgerline.functions.numeric import ratio, round_half_away

__all__ = [
    "COUNTERS",
    "DAYS_WITH",
    "MONTHLY_TOTALS",
    "flag",
    "month_index",
    "month_start",
    "months_between_starts",
    "months_into_period",
    "ratio",
    "round_half_away",
    "row_total",
]
