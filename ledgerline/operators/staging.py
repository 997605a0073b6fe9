"""Staging: projection, key not-null filters, internal exclusion, row totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.activity import COUNTERS, row_total
from ledgerline.sources.files import Sources


def stg_billing_accounts(billing_accounts: DataFrame) -> DataFrame:
    return billing_accounts.select(
        "billing_account_id",
        "billing_account_name",
        "billing_account_bridge_id",
        "customer_segment",
        "created_date",
    ).where(F.col("billing_account_id").isNotNull())


def stg_app_accounts(app_accounts: DataFrame) -> DataFrame:
    # `flag = false`: a NULL flag drops the row as well (three-valued logic).
    return app_accounts.select(
        "app_account_id",
        "app_account_name",
        "app_parent_account_id",
        "app_root_account_id",
        "billing_account_bridge_id",
        "signup_date",
        "trial_end_date",
        "is_internal_account",
    ).where(F.col("app_account_id").isNotNull() & (F.col("is_internal_account") == F.lit(False)))


def stg_app_users(app_users: DataFrame) -> DataFrame:
    return app_users.select(
        "app_user_id",
        "app_user_name",
        "app_account_id",
        "seat_tiers_array",
        "signup_date",
        "is_account_owner",
        "is_internal_user",
    ).where(F.col("app_user_id").isNotNull() & (F.col("is_internal_user") == F.lit(False)))


def stg_usage_daily(app_usage_daily: DataFrame) -> DataFrame:
    """One row per user and active day; ``total_activity`` is NULL if any counter is NULL."""
    return app_usage_daily.select("date", "app_user_id", *COUNTERS, row_total().alias("total_activity")).where(
        F.col("app_user_id").isNotNull() & F.col("date").isNotNull()
    )


def stg_arr_daily(arr_daily: DataFrame) -> DataFrame:
    return arr_daily.select(
        "date",
        "billing_account_id",
        "starting_arr",
        "ending_arr",
        (F.col("ending_arr") - F.col("starting_arr")).alias("arr_change"),
    ).where(F.col("billing_account_id").isNotNull() & F.col("date").isNotNull())


@dataclass(frozen=True)
class Staged:
    billing_accounts: DataFrame
    app_accounts: DataFrame
    app_users: DataFrame
    usage_daily: DataFrame
    arr_daily: DataFrame


def stage(src: Sources) -> Staged:
    return Staged(
        billing_accounts=stg_billing_accounts(src.billing_accounts),
        app_accounts=stg_app_accounts(src.app_accounts),
        app_users=stg_app_users(src.app_users),
        usage_daily=stg_usage_daily(src.app_usage_daily),
        arr_daily=stg_arr_daily(src.arr_daily),
    )


def staging_row_counts(st: Staged) -> DataFrame:
    """Smoke check: row count of each staging model, one row per model."""
    parts = [
        ("stg_billing_accounts", st.billing_accounts),
        ("stg_app_accounts", st.app_accounts),
        ("stg_app_users", st.app_users),
        ("stg_usage_daily", st.usage_daily),
        ("stg_arr_daily", st.arr_daily),
    ]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("model"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
