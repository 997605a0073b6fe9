"""Billing-account x month signals that feed the lifecycle mart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.activity import DAYS_WITH, flag
from ledgerline.functions.dates import as_of_month, month_index, month_start
from ledgerline.functions.numeric import exact_avg
from ledgerline.rules import Rules
from ledgerline.session import shuffle_partitions

# App rows of one account that may meet in one task of the fan-out, each with all of the account's months.
APPS_PER_SLICE = 2000
# No account below this part of all app rows is split, which bounds the number of accounts that are.
MAX_HEAVY = 1024

# Monthly usage totals in the order the billing roll-up emits them.
USAGE_SIGNAL_COLUMNS = (
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
)


def arr_signals(arr_monthly: DataFrame) -> DataFrame:
    """Monthly ARR with ``prev_month_arr``: the previous *available* month of the account.
    The window partition is one account's months, so it stays small for any account."""
    w = Window.partitionBy("billing_account_id").orderBy("snapshot_month")
    return arr_monthly.select(
        "billing_account_id",
        "snapshot_month",
        "starting_arr",
        "ending_arr",
        "arr_change",
        "arr_movement_type",
        F.lag("ending_arr").over(w).alias("prev_month_arr"),
    )


def expansion_flags(arr_monthly: DataFrame, as_of: dt.date, rules: Rules = Rules()) -> dict[str, Column]:
    """``had_expansion`` and ``expanded_last_3_months`` as columns over monthly ARR rows.

    Default (the SQL): this month's movement is an expansion and the month lies within
    the recent window before the ``as_of`` month. With ``rules.trailing_expansion``: any
    expansion in the N calendar months before this month (a range frame over the month
    index, per account, so the window partition is one account's months)."""
    is_exp = F.col("arr_movement_type") == F.lit("expansion")
    had = flag(is_exp)
    if rules.trailing_expansion:
        n = rules.recent_expansion_months
        w = Window.partitionBy("billing_account_id").orderBy(month_index("snapshot_month")).rangeBetween(-n, -1)
        recent = F.coalesce(F.max(had).over(w), F.lit(0))
    else:
        in_window = F.col("snapshot_month") >= F.add_months(as_of_month(as_of), -rules.recent_expansion_months)
        recent = flag(is_exp & in_window)
    return {"had_expansion": had, "expanded_last_3_months": recent}


def expansion_signals(arr_monthly: DataFrame, as_of: dt.date, rules: Rules = Rules()) -> DataFrame:
    """Per (account, month) expansion flags. With the default rule each group has one
    row, so these are row flags (no aggregation or shuffle)."""
    flags = expansion_flags(arr_monthly, as_of, rules)
    return arr_monthly.select(
        "billing_account_id",
        "snapshot_month",
        flags["had_expansion"].alias("had_expansion"),
        flags["expanded_last_3_months"].alias("expanded_last_3_months"),
    )


def _bridge_keys(bridge: DataFrame) -> DataFrame:
    # inner joins on app_account_id: NULL app ids never match, so drop them before the shuffle
    return bridge.where(F.col("app_account_id").isNotNull()).select("app_account_id", "billing_account_id")


def usage_by_billing_month(usage_monthly: DataFrame, bridge: DataFrame) -> DataFrame:
    """App-account usage rolled up to billing account x month. A shared app account
    counts toward every billing account it is bridged to."""
    j = usage_monthly.join(_bridge_keys(bridge), on="app_account_id", how="inner")
    sums = [F.sum(c).alias(c) for c in USAGE_SIGNAL_COLUMNS]
    return j.groupBy("billing_account_id", "snapshot_month").agg(*sums, F.sum("active_users").alias("active_users"))


def adoption_by_billing_month(adoption_monthly: DataFrame, bridge: DataFrame) -> DataFrame:
    """Adoption rolled up to billing account x month, plus the previous month's rate.

    The rate is the unweighted mean of per-app rates, which have two decimals. Rows with a NULL month
    (users without usage) never match a snapshot month; they are dropped before the
    window, because a NULL month must not become the "previous" month of the first
    real month (SQL sorts NULLs last there).
    """
    j = adoption_monthly.where(F.col("snapshot_month").isNotNull()).join(
        _bridge_keys(bridge), on="app_account_id", how="inner"
    )
    g = j.groupBy("billing_account_id", "snapshot_month").agg(
        F.sum("total_users").alias("total_users"),
        F.sum("active_users").alias("active_users"),
        F.sum("owner_count").alias("owner_count"),
        exact_avg(F.col("active_user_rate"), 100).alias("active_user_rate"),
        F.max("has_any_activity").alias("has_any_activity"),
        *[F.sum(c).alias(c) for c in DAYS_WITH.values()],
    )
    w = Window.partitionBy("billing_account_id").orderBy(F.col("snapshot_month").asc_nulls_last())
    return g.withColumn("prev_month_active_user_rate", F.lag("active_user_rate").over(w))


def heavy_accounts(bridge: DataFrame, apps_per_slice: int = APPS_PER_SLICE) -> dict:
    """Billing accounts with so many app rows that their fan-out is split, and into how many slices.

    One small job: counts by account (partial aggregates), of which only accounts above both
    ``apps_per_slice`` and 1/``MAX_HEAVY`` of all rows are fetched, so fewer than ``MAX_HEAVY``
    however large the table. A slice has about as many rows as the larger of the two limits."""
    apps = bridge.groupBy("billing_account_id").agg(F.count(F.lit(1)).alias("apps"))
    limit = F.greatest(F.lit(apps_per_slice), F.ceil(apps.agg(F.sum("apps")).scalar() / F.lit(MAX_HEAVY)))
    slices = F.ceil(F.col("apps") / limit).cast("int").alias("slices")
    return {r[0]: r[1] for r in apps.where(F.col("apps") > limit).select("billing_account_id", slices).collect()}


def _in_slices(side: DataFrame, heavy: dict, own: Column | None = None) -> DataFrame:
    """``side`` dealt out by account and slice: a row goes to the slice that its hash ``own``
    names, or to each slice of its account. Other accounts have one slice. The number of
    partitions is given, so that slices that are small before the fan-out are not merged; it is
    the one that shuffles start with, which grows with the tables (``session.bound_tasks``)."""
    spark = side.sparkSession
    schema = T.StructType([side.schema["billing_account_id"], T.StructField("_slices", T.IntegerType())])
    counted = side.join(F.broadcast(spark.createDataFrame(list(heavy.items()), schema)), "billing_account_id", "left")
    n = F.coalesce(F.col("_slices"), F.lit(1))
    dealt = F.explode(F.sequence(F.lit(0), n - 1)) if own is None else F.pmod(own, n).cast("int")
    dealt_out = counted.select(*side.columns, dealt.alias("_slice"))
    return dealt_out.repartition(shuffle_partitions(spark), "billing_account_id", "_slice")


def app_fan_out(bridge: DataFrame, stg_billing: DataFrame, by_month: DataFrame, heavy: dict | None = None) -> DataFrame:
    """Billing x app attributes of the spine for every row of ``by_month`` of the account.

    Every attribute row of a billing id meets every app of that id, also when the id is
    repeated with other attributes or another bridge. Both sides are dealt out by billing
    id once; making them distinct and joining them then needs no further exchange.

    With ``heavy`` (``heavy_accounts``) the apps of those accounts are dealt to slices, the
    account's attributes and months (both few) go to each slice, and no task gets a whole heavy
    account; this shuffles ``by_month`` once more, so it is done only when there is such an
    account."""
    attributes = stg_billing.select(
        "billing_account_id", "billing_account_name", "customer_segment", F.col("created_date").alias("billing_created_date")
    )
    apps = bridge.select("billing_account_id", "app_account_id", "app_signup_date", "trial_end_date")
    keys = ["billing_account_id"]
    if heavy:
        keys.append("_slice")
        # equal rows have equal hashes, so making them distinct within slices is enough
        apps = _in_slices(apps, heavy, F.xxhash64("app_account_id", "app_signup_date", "trial_end_date"))
        attributes, by_month = _in_slices(attributes, heavy), _in_slices(by_month, heavy)
    else:
        attributes, apps = attributes.repartition("billing_account_id"), apps.repartition("billing_account_id")
    joined = attributes.dropDuplicates().join(apps.dropDuplicates(), on=keys, how="inner")
    return joined.join(by_month, on=keys, how="inner").drop("_slice")


def account_spine(bridge: DataFrame, stg_billing: DataFrame, stg_arr: DataFrame, heavy: dict | None = None) -> DataFrame:
    """Billing x app account x month: every month with ARR rows of a staged billing
    account. Months are made distinct *before* the join, so daily ARR rows never fan out."""
    months = stg_arr.select("billing_account_id", month_start("date").alias("snapshot_month")).distinct()
    return app_fan_out(bridge, stg_billing, months, heavy)


def new_account_flag(rules: Rules = Rules()) -> Column:
    """1 while the month is not after the month of (signup or creation) + N days;
    months before signup count as new; no dates -> 0."""
    anchor = F.coalesce(F.col("app_signup_date"), F.col("billing_created_date"))
    return flag(F.col("snapshot_month") <= F.trunc(F.date_add(anchor, rules.new_account_days), "MM"))


def activity_by_billing_month(app_month: DataFrame, bridge: DataFrame) -> DataFrame:
    """Usage and adoption of bridged app accounts rolled up to billing account x month
    in one aggregation, plus the previous month's (unweighted mean) rate.

    Equal to ``usage_by_billing_month`` joined with ``adoption_by_billing_month``:
    both sum over the same app-month rows, and a user with usage rows in a month is
    counted in ``total_users`` exactly as in the usage model's ``active_users``.
    """
    j = app_month.join(_bridge_keys(bridge), on="app_account_id", how="inner")
    g = j.groupBy("billing_account_id", "snapshot_month").agg(
        *[F.sum(c).alias(c) for c in USAGE_SIGNAL_COLUMNS],
        F.sum("total_users").alias("total_users"),
        F.sum("active_users").alias("active_users"),
        F.sum("owner_count").alias("owner_count"),
        exact_avg(F.col("active_user_rate"), 100).alias("active_user_rate"),
        F.max("has_any_activity").alias("has_any_activity"),
        *[F.sum(c).alias(c) for c in DAYS_WITH.values()],
    )
    w = Window.partitionBy("billing_account_id").orderBy("snapshot_month")
    return g.withColumn("prev_month_active_user_rate", F.lag("active_user_rate").over(w))
