"""Sinks: ordered CSV reports with a header, and the month-partitioned parquet mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans import profile, reports
from ledgerline.rules import Rules
from ledgerline.sources.files import Sources

# Report name -> sort keys of the exported file ("-": descending).
REPORT_ORDER = {
    "account_lifecycle_signals": ("snapshot_month", "billing_account_id"),
    "retention_analysis": ("customer_segment", "retention_status"),
    "retention_analysis_3way": ("customer_segment", "retention_status"),
    "product_insights_monthly": ("customer_segment", "snapshot_month"),
    "leadership_summary": ("customer_segment", "period_name"),
    "lifecycle_breakdown": ("snapshot_month", "lifecycle_segment", "recommended_action"),
}
CHECK_ORDER = {
    "dq_unmatched_billing": ("billing_accounts_without_app_account",),
    "dq_duplicate_bridge": ("billing_account_id", "app_account_id"),
    "dq_repeat_churn": ("-churn_months", "billing_account_id"),
    "dq_usage_after_zero_arr": ("billing_account_id", "snapshot_month"),
    "dq_zero_usage_retained": ("activity_status",),
    "dq_multi_movement": ("-distinct_movement_types", "billing_account_id"),
    "dq_unique_keys": ("model",),
    "dq_not_null": ("model", "column_name"),
    "dq_accepted_values": ("column_name",),
    "run_checks": ("check_name",),
}
# The listings: largest count first, ties by the group keys; otherwise by date or group.
PROFILE_ORDER = {
    "names_per_bridge": ("-billing_account_names", "billing_account_bridge_id"),
    "multi_app_accounts": ("-app_account_count", "billing_account_id"),
    "bridge_profile": ("total_rows",),
    "arr_profile": ("total_accounts",),
    "arr_overview": ("earliest",),
    "arr_movement_by_month": ("snapshot_month",),
    "arr_movement_counts": ("-account_months", "arr_movement_type"),
    "zero_arr_rows_sample": ("billing_account_id", "date"),
    "zero_usage_app_accounts": ("signup_date", "app_account_id"),
    "zero_usage_by_signup_month": ("signup_month",),
    "utilisation_buckets": ("-account_months", "active_user_bucket"),
    "utilisation_buckets_fine": ("active_user_bucket",),
    "co_adoption": ("-account_months", "meeting_usage", "ai_chat_usage"),
    "segment_counts": ("-count", "customer_segment"),
    "internal_counts": ("is_internal_account",),
    "seat_tier_top10": ("-count", "seat_tiers_array"),
    "usage_overview": ("avg_meetings",),
    "distinct_billing_names": ("distinct_billing_account_names",),
}
# listings with a row per account or bridge id, which may be long: several files, in order
_LONG_PROFILES = ("names_per_bridge", "multi_app_accounts", "zero_usage_app_accounts")


def write_csv_report(df: DataFrame, path: str, order_by: tuple[str, ...], single_file: bool = False) -> None:
    """Sorted CSV with a header (NULLs last; "-" before a key: descending). The sort is a
    range shuffle, so part files are in order; ``single_file`` is only for reports whose
    size is bounded by their group keys, never for account-level rows."""
    keys = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order_by]
    out = df.orderBy(*keys)
    if single_file:
        out = out.coalesce(1)  # keeps the range order: partitions are concatenated in index order
    out.write.mode("overwrite").option("header", True).csv(path)


def write_mart(mart: DataFrame, path: str) -> None:
    """The mart as parquet partitioned by month, clustered by account inside each month
    (AQE rebalances by month: small months merged, large months split across tasks)."""
    (
        mart.hint("rebalance", "snapshot_month")
        .sortWithinPartitions("snapshot_month", "billing_account_id")
        .write.mode("overwrite")
        .partitionBy("snapshot_month")
        .parquet(path)
    )


def export_reports(mart: DataFrame, as_of: dt.date | str, out_dir: str, rules: Rules = Rules()) -> dict[str, str]:
    """Write the report files: account signals (Q1/Q4/Q5), retention (Q2/Q3, and with three
    outcomes), product insights (Q6), the leadership summary (Q7) and the label breakdown."""
    frames = {
        "account_lifecycle_signals": reports.account_lifecycle_signals(mart),
        "retention_analysis": reports.retention_analysis(mart, as_of, rules),
        "retention_analysis_3way": reports.retention_analysis(mart, as_of, rules, with_contracted=False),
        "product_insights_monthly": reports.product_insights_monthly(mart),
        "leadership_summary": reports.leadership_summary(mart),
        "lifecycle_breakdown": reports.lifecycle_breakdown(mart),
    }
    paths = {}
    for name, df in frames.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        write_csv_report(df, path, REPORT_ORDER[name], single_file=name != "account_lifecycle_signals")
        paths[name] = path
    return paths


def export_profiles(src: Sources, arr_monthly: DataFrame, out_dir: str) -> dict[str, str]:
    """Write every profiling query as a sorted CSV (``PROFILE_ORDER``); no list is cut off but
    the two that are a top or a sample by definition."""
    paths = {}
    for name, order in PROFILE_ORDER.items():
        query = getattr(profile, name)
        df = query(arr_monthly) if name.startswith("arr_movement") else query(src)
        paths[name] = f"{out_dir.rstrip('/')}/{name}"
        write_csv_report(df, paths[name], order, single_file=name not in _LONG_PROFILES)
    return paths
