"""The monthly account lifecycle mart: one row per billing account x app account x month.

Billing-level signals (ARR, usage, adoption, expansion) are joined on
(billing account, month) *before* the fan-out to app accounts, so the four
signal joins run on billing-month rows; the app fan-out is the last join.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.activity import DAYS_WITH
from ledgerline.operators import classify
from ledgerline.operators.intermediate import (
    app_month_activity,
    int_account_bridge,
    int_arr_monthly,
    int_usage_monthly,
    int_user_adoption_monthly,
    user_month_usage,
)
from ledgerline.operators.signals import (
    USAGE_SIGNAL_COLUMNS,
    activity_by_billing_month,
    app_fan_out,
    arr_signals,
    expansion_flags,
    heavy_accounts,
    new_account_flag,
)
from ledgerline.operators.staging import Staged, stage
from ledgerline.plans.observed import RunChecks
from ledgerline.rules import Rules, as_date
from ledgerline.session import co_partitioned, materialize
from ledgerline.sources.files import Sources

# The 40 score columns of the mart, in output order.
SCORE_COLUMNS = (
    "billing_account_id",
    "billing_account_name",
    "customer_segment",
    "billing_created_date",
    "app_account_id",
    "app_signup_date",
    "snapshot_month",
    "starting_arr",
    "ending_arr",
    "arr_change",
    "arr_movement_type",
    "prev_month_arr",
    "total_activity",
    "total_meetings",
    "total_ai_chats",
    "total_page_views",
    "total_page_visits",
    "total_notes_viewed",
    "total_notes_synced",
    "total_dashboards_viewed",
    "total_meeting_agendas_viewed",
    "total_tasks_synced",
    "total_users",
    "active_users",
    "owner_count",
    "active_user_rate",
    "prev_month_active_user_rate",
    "has_any_activity",
    *DAYS_WITH.values(),
    "had_expansion",
    "expanded_last_3_months",
    "is_new_account",
)
LABEL_COLUMNS = ("lifecycle_segment", "is_expansion_ready", "reason_code", "recommended_action")
MART_COLUMNS = SCORE_COLUMNS + LABEL_COLUMNS

# measures that are zero when the account has no row in the signal table
_ZERO_FILLED = (
    "starting_arr",
    "ending_arr",
    "arr_change",
    *USAGE_SIGNAL_COLUMNS,
    "total_users",
    "active_users",
    "owner_count",
    "active_user_rate",
    "has_any_activity",
    *DAYS_WITH.values(),
    "had_expansion",
    "expanded_last_3_months",
)


@dataclass(frozen=True)
class Models:
    staged: Staged
    bridge: DataFrame
    arr_monthly: DataFrame
    user_month: DataFrame
    usage_monthly: DataFrame
    adoption_monthly: DataFrame


def build_models(
    src: Sources,
    user_month: DataFrame | None = None,
    arr_monthly: DataFrame | None = None,
    checks: RunChecks | None = None,
) -> Models:
    """The models of ``src``; the monthly aggregates of the daily feeds may be given
    (``plans.state``). ``checks`` counts repeated days in the aggregates made here."""
    st = stage(src)
    user_month = user_month_usage(st.usage_daily, checks and checks.usage) if user_month is None else user_month
    return Models(
        staged=st,
        bridge=int_account_bridge(st.billing_accounts, st.app_accounts),
        arr_monthly=int_arr_monthly(st.arr_daily, checks and checks.arr) if arr_monthly is None else arr_monthly,
        user_month=user_month,
        usage_monthly=int_usage_monthly(user_month, st.app_users),
        adoption_monthly=int_user_adoption_monthly(st.app_users, user_month),
    )


def billing_month_signals(m: Models, as_of: dt.date, rules: Rules = Rules()) -> DataFrame:
    """ARR (+ previous month, expansion flags), usage and adoption per (billing, month).

    Every spine month comes from the account's ARR rows, so the monthly ARR table
    is the set of (billing, month) keys; product activity is left-joined to it.
    Both sides are hash-partitioned by billing account after their windows; with
    ``spark.sql.requireAllClusterKeysForCoPartition=false`` (``session.DEFAULT_CONF``)
    the join on (billing, month) and the app fan-out on billing need no further shuffle.
    """
    arr = arr_signals(m.arr_monthly)
    arr = arr.withColumns(expansion_flags(arr, as_of, rules))
    activity = activity_by_billing_month(app_month_activity(m.user_month, m.staged.app_users), m.bridge)
    return arr.join(activity, on=["billing_account_id", "snapshot_month"], how="left")


def segment_scores(m: Models, as_of: dt.date | str, rules: Rules = Rules(), heavy: dict | None = None) -> DataFrame:
    """Spine x signals with zero-filled measures and the new-account flag (40 columns).
    The fan-out of the accounts in ``heavy`` is split (``signals.app_fan_out``)."""
    as_of = as_date(as_of)
    signals = billing_month_signals(m, as_of, rules)
    rows = app_fan_out(m.bridge, m.staged.billing_accounts, signals, heavy)
    filled = {c: F.coalesce(F.col(c), F.lit(0)) for c in _ZERO_FILLED}
    filled["is_new_account"] = new_account_flag(rules)
    return rows.withColumns(filled).select(*SCORE_COLUMNS)


def add_labels(scores: DataFrame, rules: Rules = Rules()) -> DataFrame:
    labelled = scores.withColumns(
        {
            "lifecycle_segment": classify.lifecycle_segment(rules),
            "is_expansion_ready": classify.is_expansion_ready(rules),
            "reason_code": classify.reason_code(rules),
        }
    )
    return labelled.withColumn("recommended_action", classify.recommended_action(rules))


def lifecycle_mart(m: Models, as_of: dt.date | str, rules: Rules = Rules(), heavy: dict | None = None) -> DataFrame:
    """The 44-column mart, lazily; ``heavy`` as in ``segment_scores``."""
    return add_labels(segment_scores(m, as_of, rules, heavy), rules)


def materialized_mart(src: Sources, as_of: dt.date | str, source_key: str, rules: Rules = Rules()) -> DataFrame:
    """The mart written once per (sources, as_of, rules) to the shared checkpoint folder,
    partitioned by month, and read back for the reports."""
    as_of = as_date(as_of)
    m = build_models(src)
    key = f"{source_key}|{as_of.isoformat()}|{rules!r}"
    rows = lifecycle_mart(m, as_of, rules)
    with co_partitioned(rows.sparkSession):
        return materialize(
            rows,
            "mart",
            key,
            partition_by="snapshot_month",
            cluster_by=("billing_account_id",),
            write_as=lambda: lifecycle_mart(m, as_of, rules, heavy_accounts(m.bridge)),
        )
