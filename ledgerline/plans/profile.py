"""Exploration and profiling queries over the raw sources and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.activity import flag, row_total
from ledgerline.functions.dates import month_start
from ledgerline.functions.numeric import exact_avg, ratio, round_half_away
from ledgerline.operators.joins import left_join_null_keys_apart
from ledgerline.sources.files import Sources


def _raw_bridge(src: Sources) -> DataFrame:
    """Raw billing accounts LEFT JOIN raw external app accounts on the bridge id; rows without
    a bridge id skip the join."""
    apps = src.app_accounts.where(F.col("is_internal_account") == F.lit(False)).select(
        "billing_account_bridge_id", "app_account_id"
    )
    ba = src.billing_accounts.where(F.col("billing_account_id").isNotNull()).select(
        "billing_account_id", "billing_account_bridge_id"
    )
    return left_join_null_keys_apart(ba, apps, "billing_account_bridge_id", ["app_account_id"])


def multi_app_accounts(src: Sources) -> DataFrame:
    """Billing accounts bridged to more than one app account."""
    return (
        _raw_bridge(src)
        .groupBy("billing_account_id")
        .agg(F.count("app_account_id").alias("app_account_count"))
        .where(F.col("app_account_count") > 1)
    )


def bridge_profile(src: Sources) -> DataFrame:
    """Rows, distinct billing accounts, distinct app accounts and distinct combinations
    (keyed as ``billing-app`` text, ``none`` for no app) of the raw bridge."""
    combo = F.concat(
        F.col("billing_account_id").cast("string"),
        F.lit("-"),
        F.coalesce(F.col("app_account_id").cast("string"), F.lit("none")),
    )
    # distinct links first, then plain counts of them: no row-multiplying Expand. Two links may
    # read alike as text, so only the combinations are told apart by it
    links = _raw_bridge(src).groupBy("billing_account_id", "app_account_id").agg(F.count(F.lit(1)).alias("n"))
    per_billing = links.groupBy("billing_account_id").agg(F.sum("n").alias("n"))
    apps = links.where(F.col("app_account_id").isNotNull()).groupBy("app_account_id").agg(F.lit(1).alias("one"))
    combinations = links.groupBy(combo.alias("combination")).agg(F.lit(1).alias("one"))
    return per_billing.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count("billing_account_id").alias("unique_billing_accounts"),
    ).select(
        "total_rows",
        "unique_billing_accounts",
        combinations.agg(F.count(F.lit(1))).scalar().alias("unique_combinations"),
        apps.agg(F.count(F.lit(1))).scalar().alias("unique_app_accounts"),
    )


def arr_movement_by_month(arr_monthly: DataFrame) -> DataFrame:
    """Accounts per month and movement type, one column per type (0 when absent).
    Counted on the monthly table, so daily rows never multiply the counts."""
    types = ["churned", "expansion", "contraction", "stable"]
    p = arr_monthly.groupBy("snapshot_month").pivot("arr_movement_type", types).agg(F.count(F.lit(1)))
    return p.select("snapshot_month", *[F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t) for t in types])


def arr_movement_counts(arr_monthly: DataFrame) -> DataFrame:
    """Account-months per movement type."""
    return arr_monthly.groupBy("arr_movement_type").agg(F.count(F.lit(1)).alias("account_months"))


def arr_profile(src: Sources) -> DataFrame:
    """Range of daily ending ARR and how many accounts ever sit at zero. Per-account
    partials first, so the distinct account counts need no Expand over daily rows."""
    per_account = src.arr_daily.groupBy("billing_account_id").agg(
        F.min("ending_arr").alias("lo"),
        F.max("ending_arr").alias("hi"),
        F.max(flag(F.col("ending_arr") == 0)).alias("has_zero"),
    )
    known = F.col("billing_account_id").isNotNull()
    return per_account.agg(
        F.min("lo").alias("min_ending_arr"),
        F.max("hi").alias("max_ending_arr"),
        F.count_if(known & (F.col("has_zero") == 1)).alias("accounts_with_zero_arr"),
        F.count("billing_account_id").alias("total_accounts"),
    )


def zero_arr_rows_sample(src: Sources, n: int = 10) -> DataFrame:
    """A look at daily ARR rows at zero: the first ``n`` by account and date (a sample is
    the feature; the order makes it repeatable, a top-k rather than a full sort)."""
    return (
        src.arr_daily.where(F.col("ending_arr") == 0)
        .orderBy(F.col("billing_account_id").asc_nulls_last(), F.col("date").asc_nulls_last())
        .limit(n)
    )


def _user_activity(src: Sources) -> DataFrame:
    """Summed row totals per app account over raw external users and their usage."""
    usage = (
        src.app_usage_daily.select("app_user_id", row_total().alias("row_total"))
        .groupBy("app_user_id")
        .agg(F.sum("row_total").alias("user_total"))
    )
    users = src.app_users.where(F.col("is_internal_user") == F.lit(False)).select("app_user_id", "app_account_id")
    return (
        users.join(usage, on="app_user_id", how="left")
        .groupBy("app_account_id")
        .agg(F.sum("user_total").alias("total_activity"))
    )


def zero_usage_app_accounts(src: Sources) -> DataFrame:
    """External app accounts whose users have no (or only zero) activity ever."""
    apps = src.app_accounts.where(F.col("is_internal_account") == F.lit(False)).select(
        "app_account_id", "app_account_name", "signup_date"
    )
    act = _user_activity(src).where(F.col("app_account_id").isNotNull())
    j = apps.join(act, on="app_account_id", how="left")
    return j.where(F.col("total_activity").isNull() | (F.col("total_activity") == 0)).select(
        "app_account_id", "app_account_name", "signup_date"
    )


def zero_usage_by_signup_month(src: Sources) -> DataFrame:
    return (
        zero_usage_app_accounts(src)
        .groupBy(month_start("signup_date").alias("signup_month"))
        .agg(F.count(F.lit(1)).alias("zero_usage_accounts"))
    )


def _raw_account_months(src: Sources) -> DataFrame:
    """Per (app account, month) over raw external users LEFT JOIN raw usage:
    users with usage rows, users with activity, summed meetings and AI chats.

    Usage is pre-aggregated to (user, month) before the join (partial aggregation before
    the shuffle); then two levels (user, then account) replace the COUNT DISTINCTs."""
    users = src.app_users.where(F.col("is_internal_user") == F.lit(False)).select("app_user_id", "app_account_id")
    usage = (
        src.app_usage_daily.where(F.col("app_user_id").isNotNull())
        .groupBy("app_user_id", month_start("date").alias("snapshot_month"))
        .agg(
            F.max(flag(row_total() > 0)).alias("active"),
            F.sum("meeting_count").alias("meetings"),
            F.sum("ai_chat_message_submitted_count").alias("ai_chats"),
        )
    )
    per_user = (
        users.join(usage, on="app_user_id", how="left")
        .groupBy("app_account_id", "snapshot_month", "app_user_id")
        .agg(F.max("active").alias("active"), F.sum("meetings").alias("meetings"), F.sum("ai_chats").alias("ai_chats"))
    )
    # a NULL user id is no user: COUNT(DISTINCT id) skips it
    known = F.col("app_user_id").isNotNull()
    return per_user.groupBy("app_account_id", "snapshot_month").agg(
        F.count("app_user_id").alias("total_users"),
        F.coalesce(F.sum(F.when(known, F.col("active"))), F.lit(0)).alias("active_users"),
        F.sum("meetings").alias("days_with_meetings"),
        F.sum("ai_chats").alias("days_with_ai_chat"),
    )


def _bucketed(src: Sources, bucket: Column) -> DataFrame:
    am = _raw_account_months(src).where(F.col("snapshot_month").isNotNull())
    return am.groupBy(bucket.alias("active_user_bucket")).agg(F.count(F.lit(1)).alias("account_months"))


def utilisation_buckets(src: Sources) -> DataFrame:
    """Account-months by share of active users, six bands."""
    r = ratio(F.col("active_users"), F.col("total_users"))
    bucket = (
        F.when(F.col("active_users") == 0, F.lit("0% active"))
        .when(r < 0.25, F.lit("1-24% active"))
        .when(r < 0.50, F.lit("25-49% active"))
        .when(r < 0.75, F.lit("50-74% active"))
        .when(r < 1.00, F.lit("75-99% active"))
        .otherwise(F.lit("100% active"))
    )
    return _bucketed(src, bucket)


def utilisation_buckets_fine(src: Sources) -> DataFrame:
    """Account-months by share of active users in tenths, with the share of all
    account-months (the total is a window over at most twelve aggregated rows)."""
    r = ratio(F.col("active_users"), F.col("total_users"))
    bucket = F.when(r == 0, F.lit("0%"))
    # Upper bounds (inclusive) and labels of the 1-90% bands.
    for upper, label in (
        (0.10, "1-10%"),
        (0.20, "11-20%"),
        (0.30, "21-30%"),
        (0.40, "31-40%"),
        (0.50, "41-50%"),
        (0.60, "51-60%"),
        (0.70, "61-70%"),
        (0.80, "71-80%"),
        (0.90, "81-90%"),
    ):
        bucket = bucket.when(r <= upper, F.lit(label))
    bucket = bucket.when(r < 1.00, F.lit("91-99%")).otherwise(F.lit("100%"))
    b = _bucketed(src, bucket)
    total = F.sum("account_months").over(Window.partitionBy())
    return b.select(
        "active_user_bucket",
        "account_months",
        round_half_away(F.col("account_months") * F.lit(100.0) / total, 1).alias("pct_of_total"),
    )


def co_adoption(src: Sources) -> DataFrame:
    """Meetings x AI chat usage matrix: account-months and their mean active-user rate."""
    am = _raw_account_months(src).where(F.col("snapshot_month").isNotNull())
    rate = ratio(F.col("active_users"), F.col("total_users"))
    return am.groupBy(
        F.when(F.col("days_with_meetings") > 0, F.lit("uses meetings")).otherwise(F.lit("no meetings")).alias(
            "meeting_usage"
        ),
        F.when(F.col("days_with_ai_chat") > 0, F.lit("uses ai chat")).otherwise(F.lit("no ai chat")).alias(
            "ai_chat_usage"
        ),
    ).agg(
        F.count(F.lit(1)).alias("account_months"),
        round_half_away(exact_avg(rate, 10**9), 2).alias("avg_active_user_rate"),
    )


def segment_counts(src: Sources) -> DataFrame:
    return src.billing_accounts.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("count"))


def internal_counts(src: Sources) -> DataFrame:
    return src.app_accounts.groupBy("is_internal_account").agg(F.count(F.lit(1)).alias("count"))


def seat_tier_top10(src: Sources) -> DataFrame:
    """The ten most frequent raw seat-tier values (a top-k; ties broken by value)."""
    return (
        src.app_users.groupBy("seat_tiers_array")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col("seat_tiers_array").asc_nulls_last())
        .limit(10)
    )


def arr_overview(src: Sources) -> DataFrame:
    """Date range, accounts and mean ending ARR of the daily ARR rows (two levels:
    per account, then global)."""
    per_account = src.arr_daily.groupBy("billing_account_id").agg(
        F.min("date").alias("lo"),
        F.max("date").alias("hi"),
        F.sum("ending_arr").alias("arr_sum"),
        F.count("ending_arr").alias("arr_n"),
    )
    return per_account.agg(
        F.min("lo").alias("earliest"),
        F.max("hi").alias("latest"),
        F.count("billing_account_id").alias("accounts"),
        round_half_away(F.sum("arr_sum") / F.sum("arr_n"), 2).alias("avg_arr"),
    )


def usage_overview(src: Sources) -> DataFrame:
    u = src.app_usage_daily
    return u.agg(
        round_half_away(F.avg("meeting_count"), 2).alias("avg_meetings"),
        round_half_away(F.avg("page_view_count"), 2).alias("avg_page_views"),
        round_half_away(F.avg("ai_chat_message_submitted_count"), 2).alias("avg_ai_chat"),
        round_half_away(F.avg("note_synced_count"), 2).alias("avg_notes"),
    )


def names_per_bridge(src: Sources) -> DataFrame:
    """Billing account names per bridge id (the NULL bridge id is one group)."""
    return src.billing_accounts.groupBy("billing_account_bridge_id").agg(
        F.count("billing_account_name").alias("billing_account_names")
    )


def distinct_billing_names(src: Sources) -> DataFrame:
    return src.billing_accounts.agg(F.countDistinct("billing_account_name").alias("distinct_billing_account_names"))
