"""Fixed schemas of the five raw sources (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

from ledgerline.functions.activity import COUNTERS


def _s(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


def source_schemas(id_type: T.DataType = T.StringType()) -> dict[str, T.StructType]:
    """Schemas of the five source tables. Ids are only compared and counted, so their
    type is a parameter (text in production CSVs, BIGINT in the driver's tables)."""
    return {
        "billing_accounts": _s(
            ("billing_account_id", id_type),
            ("billing_account_name", T.StringType()),
            ("billing_account_bridge_id", id_type),
            ("customer_segment", T.StringType()),
            ("created_date", T.DateType()),
        ),
        "app_accounts": _s(
            ("app_account_id", id_type),
            ("app_account_name", T.StringType()),
            ("app_parent_account_id", id_type),
            ("app_root_account_id", id_type),
            ("billing_account_bridge_id", id_type),
            ("signup_date", T.DateType()),
            ("trial_end_date", T.DateType()),
            ("is_internal_account", T.BooleanType()),
        ),
        "app_users": _s(
            ("app_user_id", id_type),
            ("app_user_name", T.StringType()),
            ("app_account_id", id_type),
            ("seat_tiers_array", T.StringType()),
            ("signup_date", T.DateType()),
            ("is_account_owner", T.BooleanType()),
            ("is_internal_user", T.BooleanType()),
        ),
        "app_usage_daily": _s(
            ("date", T.DateType()),
            ("app_user_id", id_type),
            *[(c, T.LongType()) for c in COUNTERS],
        ),
        "arr_daily": _s(
            ("date", T.DateType()),
            ("billing_account_id", id_type),
            ("starting_arr", T.DoubleType()),
            ("ending_arr", T.DoubleType()),
        ),
    }


SOURCE_NAMES = ("billing_accounts", "app_accounts", "app_users", "app_usage_daily", "arr_daily")
