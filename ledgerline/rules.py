"""Tunable thresholds of the lifecycle rules, in one frozen object."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Rules:
    # The reference thresholds and windows (defaults).
    healthy_rate: float = 0.80  # active_user_rate at or above -> healthy / expansion candidate
    at_risk_rate: float = 0.60  # active_user_rate below -> at risk
    decline_factor: float = 0.98  # rate below prev * factor -> declining
    new_account_days: int = 30  # signup (or creation) + days, truncated to month
    recent_expansion_months: int = 3  # expansion counted as recent within this many months of as_of
    lookback_months: int = 3  # retained-activity look-back before the as_of month
    pre_event_months: int = 3  # months before first churn / contraction
    # Option (off by default): "expanded in the last N months" as any expansion in the N
    # calendar months before each month, as the metric notes describe, instead of the
    # SQL's flag on the expansion month itself when that month is recent.
    trailing_expansion: bool = False


def as_date(value: dt.date | str) -> dt.date:
    """Accept a date or an ISO string for the explicit run date."""
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))
