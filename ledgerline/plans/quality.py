"""Data-quality checks. Each returns the offending rows (or a one-row summary);
an empty result means the check passed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import month_start
from ledgerline.functions.numeric import round_half_away
from ledgerline.operators import classify
from ledgerline.operators.intermediate import MOVEMENT_TYPES, movement_type
from ledgerline.operators.staging import Staged
from ledgerline.plans.reports import account_outcomes
from ledgerline.rules import Rules


def dq_unmatched_billing(st: Staged) -> DataFrame:
    """Check 1: billing accounts whose bridge id matches no app account (NULL ids included)."""
    apps = st.app_accounts.select("billing_account_bridge_id").where(F.col("billing_account_bridge_id").isNotNull())
    bridge = st.billing_accounts.select("billing_account_bridge_id")
    keyed = bridge.where(F.col("billing_account_bridge_id").isNotNull())
    unmatched = keyed.join(apps.distinct(), on="billing_account_bridge_id", how="left_anti")
    # accounts without a bridge id match nothing: they are counted without a join
    unmatched = unmatched.unionByName(bridge.where(F.col("billing_account_bridge_id").isNull()))
    return unmatched.agg(F.count(F.lit(1)).alias("billing_accounts_without_app_account"))


def dq_duplicate_bridge(bridge: DataFrame) -> DataFrame:
    """Check 2: (billing, app) combinations that occur more than once."""
    return (
        bridge.groupBy("billing_account_id", "app_account_id")
        .agg(F.count(F.lit(1)).alias("ct"))
        .where(F.col("ct") > 1)
    )


def dq_repeat_churn(mart: DataFrame) -> DataFrame:
    """Check 3: accounts with churn in more than one month."""
    churn = mart.where(F.col("arr_movement_type") == F.lit("churned")).select("billing_account_id", "snapshot_month")
    # (account, month) is made distinct first; then plain counts replace COUNT DISTINCT.
    per_month = churn.distinct()
    return (
        per_month.groupBy("billing_account_id")
        .agg(
            F.count(F.lit(1)).alias("churn_months"),
            F.min("snapshot_month").alias("first_churn_month"),
            F.max("snapshot_month").alias("last_churn_month"),
        )
        .where(F.col("churn_months") > 1)
    )


def dq_usage_after_zero_arr(mart: DataFrame, limit: int | None = 20) -> DataFrame:
    """Check 4: months with zero ending ARR but product activity. The check lists the
    first ``limit`` rows by account and month (a top-k, not a full sort)."""
    rows = mart.where((F.col("ending_arr") == 0) & (F.col("total_activity") > 0)).select(
        "billing_account_id",
        "snapshot_month",
        "ending_arr",
        "total_activity",
        "active_user_rate",
        "arr_movement_type",
    )
    if limit is None:
        return rows
    return rows.orderBy("billing_account_id", "snapshot_month").limit(limit)


def dq_zero_usage_retained(mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules()) -> DataFrame:
    """Check 5: never-churned accounts with no activity in the look-back window, as a
    share of all never-churned accounts with look-back rows."""
    o = account_outcomes(mart, as_of, rules).where(
        F.col("churn_month").isNull() & F.col("total_activity_last_3_months").isNotNull()
    )
    status = F.when(F.col("total_activity_last_3_months") == 0, F.lit("zero activity")).otherwise(
        F.lit("has activity")
    )
    counts = o.groupBy(status.alias("activity_status")).agg(F.count(F.lit(1)).alias("accounts"))
    # at most two rows here, so a global window is a bounded single partition
    from pyspark.sql import Window

    total = F.sum("accounts").over(Window.partitionBy())
    return counts.select(
        "activity_status",
        "accounts",
        round_half_away(F.col("accounts") * F.lit(100.0) / total, 1).alias("pct_of_total"),
    )


def _monthly_min_max(stg_arr: DataFrame) -> DataFrame:
    g = stg_arr.groupBy("billing_account_id", month_start("date").alias("snapshot_month")).agg(
        F.min("starting_arr").alias("starting_arr"), F.max("ending_arr").alias("ending_arr")
    )
    return g.select(
        "billing_account_id", movement_type(F.col("starting_arr"), F.col("ending_arr")).alias("arr_movement_type")
    )


def _multi_movement(movements: DataFrame) -> DataFrame:
    per_type = movements.where(F.col("arr_movement_type") != F.lit("stable")).distinct()
    return (
        per_type.groupBy("billing_account_id")
        .agg(
            F.count(F.lit(1)).alias("distinct_movement_types"),
            F.concat_ws(", ", F.array_sort(F.collect_list("arr_movement_type"))).alias("movement_types"),
        )
        .where(F.col("distinct_movement_types") > 1)
    )


def dq_multi_movement(stg_arr: DataFrame) -> DataFrame:
    """Check 6 as written: per-month movement from *min* starting / *max* ending ARR,
    accounts with more than one non-stable movement type over all months. The list of
    types per account is bounded by the five movement labels."""
    return _multi_movement(_monthly_min_max(stg_arr))


def dq_multi_movement_first_last(arr_monthly: DataFrame) -> DataFrame:
    """Check 6 on the mart's own first/last monthly movement (min/max cannot see churn)."""
    return _multi_movement(arr_monthly.select("billing_account_id", "arr_movement_type"))


# ---------------------------------------------------------------- planned checks


def _key_report(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.sum(F.when(F.col("n") > 1, F.lit(1)).otherwise(F.lit(0))).alias("duplicated_keys"),
    ).select(F.lit(name).alias("model"), F.lit(", ".join(keys)).alias("key_columns"), "*")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dq_unique_keys(st: Staged, bridge: DataFrame, arr_monthly: DataFrame) -> DataFrame:
    """Planned unique-key test: rows, distinct keys and duplicated keys per model."""
    return _union(
        [
            _key_report("stg_billing_accounts", st.billing_accounts, ["billing_account_id"]),
            _key_report("stg_app_accounts", st.app_accounts, ["app_account_id"]),
            _key_report("stg_app_users", st.app_users, ["app_user_id"]),
            _key_report("stg_usage_daily", st.usage_daily, ["app_user_id", "date"]),
            _key_report("stg_arr_daily", st.arr_daily, ["billing_account_id", "date"]),
            _key_report("int_account_bridge", bridge, ["billing_account_id", "app_account_id"]),
            _key_report("int_arr_monthly", arr_monthly, ["billing_account_id", "snapshot_month"]),
        ]
    )


# Columns that must never be NULL, per model.
NOT_NULL_COLUMNS = {
    "stg_billing_accounts": ("billing_account_id",),
    "stg_app_accounts": ("app_account_id", "is_internal_account"),
    "stg_app_users": ("app_user_id", "is_internal_user"),
    "stg_usage_daily": ("app_user_id", "date"),
    "stg_arr_daily": ("billing_account_id", "date"),
    "mart_account_lifecycle_monthly": (
        "billing_account_id",
        "snapshot_month",
        "arr_movement_type",
        "lifecycle_segment",
        "is_expansion_ready",
        "reason_code",
        "recommended_action",
    ),
}


def dq_not_null(st: Staged, mart: DataFrame) -> DataFrame:
    """Planned not-null test: NULL count per checked column (one pass per model)."""
    models = {
        "stg_billing_accounts": st.billing_accounts,
        "stg_app_accounts": st.app_accounts,
        "stg_app_users": st.app_users,
        "stg_usage_daily": st.usage_daily,
        "stg_arr_daily": st.arr_daily,
        "mart_account_lifecycle_monthly": mart,
    }
    frames = []
    for model, cols in NOT_NULL_COLUMNS.items():
        counts = models[model].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rows")) for c in cols])
        frames.append(
            counts.select(F.explode(pairs).alias("p")).select(F.lit(model).alias("model"), "p.column_name", "p.null_rows")
        )
    return _union(frames)


def dq_accepted_values(mart: DataFrame) -> DataFrame:
    """Planned accepted-values test on the label columns: rows checked and rows outside
    the domain, per column."""
    # Accepted domain of each label column.
    domains = {
        "arr_movement_type": MOVEMENT_TYPES,
        "lifecycle_segment": classify.LIFECYCLE_SEGMENTS,
        "reason_code": classify.REASON_CODES,
        "recommended_action": classify.RECOMMENDED_ACTIONS,
        "is_expansion_ready": ("0", "1"),
    }
    aggs = []
    for c, values in domains.items():
        aggs.append(F.count_if(~F.col(c).cast("string").isin(*values)).alias(c))
    counts = mart.agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("rejected_rows")) for c in domains])
    return counts.select(F.col("_rows").alias("rows_checked"), F.explode(pairs).alias("p")).select(
        "p.column_name", "rows_checked", "p.rejected_rows"
    )
