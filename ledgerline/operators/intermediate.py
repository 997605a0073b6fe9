"""Intermediate models: account bridge, monthly ARR, monthly usage, monthly user adoption.

Usage is aggregated to (user, month) before it meets the users table: every hot
user or account collapses map-side, and the joins and distinct counts then run
on user-month rows instead of raw daily rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.activity import COUNTERS, DAYS_WITH, MONTHLY_TOTALS, flag
from ledgerline.functions.dates import month_start
from ledgerline.functions.numeric import ratio, round_half_away
from ledgerline.operators.joins import left_join_null_keys_apart

# The ARR movement labels.
MOVEMENT_TYPES = ("churned", "expansion", "contraction", "stable", "unknown")


def int_account_bridge(stg_billing: DataFrame, stg_apps: DataFrame) -> DataFrame:
    """Billing accounts LEFT JOIN app accounts on the bridge id (many-to-many).

    Billing accounts without a bridge id keep one row with NULL app columns; they
    bypass the shuffle join (a large share of accounts has no bridge id).
    """
    apps = stg_apps.where(F.col("is_internal_account") == F.lit(False)).select(
        "billing_account_bridge_id",
        "app_account_id",
        "app_account_name",
        "app_root_account_id",
        F.col("signup_date").alias("app_signup_date"),
        "trial_end_date",
    )
    joined = left_join_null_keys_apart(
        stg_billing,
        apps,
        "billing_account_bridge_id",
        ["app_account_id", "app_account_name", "app_root_account_id", "app_signup_date", "trial_end_date"],
    )
    return joined.select(
        "billing_account_id",
        "billing_account_name",
        "customer_segment",
        F.col("created_date").alias("billing_created_date"),
        "app_account_id",
        "app_account_name",
        "app_root_account_id",
        "app_signup_date",
        "trial_end_date",
        "billing_account_bridge_id",
    )


def movement_type(first_start: Column, last_end: Column) -> Column:
    """ARR movement of a month from its first starting and last ending ARR; first match wins."""
    return (
        F.when((last_end == 0) & (first_start > 0), F.lit("churned"))
        .when(last_end > first_start, F.lit("expansion"))
        .when(last_end < first_start, F.lit("contraction"))
        .when(last_end == first_start, F.lit("stable"))
        .otherwise(F.lit("unknown"))
    )


def _watched_days(watch: Callable | None) -> list[Column]:
    """For ``watch`` (``plans.observed``): rows of a key and month, and a bit for each of its days."""
    if watch is None:
        return []
    return [F.count(F.lit(1)).alias("_rows"), F.expr("bit_or(shiftleft(1, day(date) - 1))").alias("_days")]


def int_arr_monthly(stg_arr: DataFrame, watch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Daily ARR -> one row per (billing account, month).

    ``min_by``/``max_by`` on the date are the ordered first/last values and keep a
    NULL value if that is what the first/last day holds; both are partial
    aggregates, so each hot account is combined map-side before the shuffle.
    """
    g = stg_arr.groupBy("billing_account_id", month_start("date").alias("snapshot_month")).agg(
        F.min_by("starting_arr", "date").alias("starting_arr"),
        F.max_by("ending_arr", "date").alias("ending_arr"),
        *_watched_days(watch),
    )
    g = watch(g) if watch else g
    return g.select(
        "billing_account_id",
        "snapshot_month",
        "starting_arr",
        "ending_arr",
        (F.col("ending_arr") - F.col("starting_arr")).alias("arr_change"),
        movement_type(F.col("starting_arr"), F.col("ending_arr")).alias("arr_movement_type"),
    )


def user_month_usage(stg_usage: DataFrame, watch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Daily usage pre-aggregated to (user, month): counter sums, summed row totals,
    an activity flag and per-counter active-day counts."""
    aggs = [F.sum(c).alias(c) for c in COUNTERS]
    aggs.append(F.sum("total_activity").alias("total_activity"))
    aggs.append(F.max(flag(F.col("total_activity") > 0)).alias("is_active"))
    aggs += [F.sum(flag(F.col(c) > 0)).alias("days_" + c) for c in COUNTERS]
    g = stg_usage.groupBy("app_user_id", month_start("date").alias("snapshot_month")).agg(*aggs, *_watched_days(watch))
    return watch(g).drop("_rows", "_days") if watch else g


def int_usage_monthly(user_month: DataFrame, stg_users: DataFrame) -> DataFrame:
    """Monthly usage per app account. Usage of users missing from the users table
    (internal or unknown) stays in a NULL-account group."""
    users = stg_users.select("app_user_id", "app_account_id")
    joined = user_month.join(users, on="app_user_id", how="left")
    totals = [F.sum(c).alias(MONTHLY_TOTALS[c]) for c in COUNTERS]
    return joined.groupBy("app_account_id", "snapshot_month").agg(
        # the only distinct aggregate: planned without Expand, and its merge step
        # reuses the join's partitioning on app_user_id
        F.countDistinct("app_user_id").alias("active_users"),
        *totals,
        F.sum("total_activity").alias("total_activity"),
    )


def int_user_adoption_monthly(stg_users: DataFrame, user_month: DataFrame) -> DataFrame:
    """Monthly adoption per app account.

    Users without any usage give one row per account with a NULL month. The three
    distinct user counts are computed in two levels -- per (account, month, user)
    flags, then sums -- which is exact and avoids the row-multiplying Expand that
    several COUNT DISTINCTs would plan.
    """
    users = stg_users.where(
        (F.col("is_internal_user") == F.lit(False)) & F.col("app_account_id").isNotNull()
    ).select("app_user_id", "app_account_id", "is_account_owner")
    joined = users.join(user_month, on="app_user_id", how="left")
    per_user = joined.groupBy("app_account_id", "snapshot_month", "app_user_id").agg(
        F.coalesce(F.max("is_active"), F.lit(0)).alias("is_active"),
        F.max(flag(F.col("is_account_owner") == F.lit(True))).alias("is_owner"),
        *[F.coalesce(F.sum("days_" + c), F.lit(0)).alias("days_" + c) for c in DAYS_WITH],
    )
    g = per_user.groupBy("app_account_id", "snapshot_month").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.sum("is_active").alias("active_users"),
        F.sum("is_owner").alias("owner_count"),
        F.max("is_active").alias("has_any_activity"),
        *[F.sum("days_" + c).alias(name) for c, name in DAYS_WITH.items()],
    )
    rate = round_half_away(ratio(F.col("active_users"), F.col("total_users")), 2)
    return g.select(
        "app_account_id",
        "snapshot_month",
        "total_users",
        "active_users",
        "owner_count",
        rate.alias("active_user_rate"),
        "has_any_activity",
        *DAYS_WITH.values(),
    )


def app_month_activity(user_month: DataFrame, stg_users: DataFrame) -> DataFrame:
    """Usage *and* adoption measures per (app account, month) from one join and one
    aggregation, for the mart.

    The mart only keeps app accounts bridged to a billing account and months that
    have usage, so both models reduce to the inner join of users with their
    user-month usage: the NULL-account and NULL-month groups of the standalone
    models never reach it. Computing them together scans and shuffles usage once.
    """
    users = stg_users.where(
        (F.col("is_internal_user") == F.lit(False)) & F.col("app_account_id").isNotNull()
    ).select("app_user_id", "app_account_id", "is_account_owner")
    joined = user_month.join(users, on="app_user_id", how="inner")
    per_user = joined.groupBy("app_account_id", "snapshot_month", "app_user_id").agg(
        *[F.sum(c).alias(c) for c in COUNTERS],
        F.sum("total_activity").alias("total_activity"),
        F.max("is_active").alias("is_active"),
        F.max(flag(F.col("is_account_owner") == F.lit(True))).alias("is_owner"),
        *[F.sum("days_" + c).alias("days_" + c) for c in DAYS_WITH],
    )
    g = per_user.groupBy("app_account_id", "snapshot_month").agg(
        F.count(F.lit(1)).alias("total_users"),
        F.sum("is_active").alias("active_users"),
        F.sum("is_owner").alias("owner_count"),
        F.max("is_active").alias("has_any_activity"),
        *[F.sum(c).alias(MONTHLY_TOTALS[c]) for c in COUNTERS],
        F.sum("total_activity").alias("total_activity"),
        *[F.sum("days_" + c).alias(name) for c, name in DAYS_WITH.items()],
    )
    rate = round_half_away(ratio(F.col("active_users"), F.col("total_users")), 2)
    return g.withColumn("active_user_rate", rate)
