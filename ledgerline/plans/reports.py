"""Reports on the lifecycle mart: account signals, retention, product insights, leadership.

All reports take the mart (a DataFrame) and an explicit ``as_of`` run date; none
reads ``current_date``. Sorting belongs to the sink (``ledgerline.plans.sinks``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.activity import flag
from ledgerline.functions.dates import as_of_month, months_into_period
from ledgerline.functions.numeric import exact_avg, round_half_away
from ledgerline.rules import Rules, as_date
from ledgerline.session import latest_partition

ACCOUNT_SIGNAL_COLUMNS = (
    "snapshot_month",
    "billing_account_id",
    "billing_account_name",
    "customer_segment",
    "lifecycle_segment",
    "is_expansion_ready",
    "recommended_action",
    "reason_code",
)

COHORT_MEASURES = (
    "active_user_rate",
    "total_meetings",
    "total_ai_chats",
    "days_with_meetings",
    "days_with_dashboards",
    "days_with_notes_synced",
    "days_with_tasks",
    "total_activity",
)
COHORT_COLUMNS = ("billing_account_id", "customer_segment", "retention_status", *COHORT_MEASURES)

# Fixed values: (output column, mart column) of the retention profile averages.
RETENTION_AVERAGES = (
    ("avg_active_user_rate", "active_user_rate"),
    ("avg_meetings", "total_meetings"),
    ("avg_ai_chats", "total_ai_chats"),
    ("avg_days_with_meetings", "days_with_meetings"),
    ("avg_days_with_notes_synced", "days_with_notes_synced"),
    ("avg_days_with_tasks", "days_with_tasks"),
    ("avg_total_activity", "total_activity"),
)
# Fixed values: (output column, mart column) of the product insight averages.
INSIGHT_AVERAGES = (
    ("avg_active_user_rate", "active_user_rate"),
    ("avg_meetings", "total_meetings"),
    ("avg_ai_chats", "total_ai_chats"),
    ("avg_days_with_meetings", "days_with_meetings"),
    ("avg_days_with_notes_synced", "days_with_notes_synced"),
    ("avg_days_with_tasks", "days_with_tasks"),
    ("avg_days_with_dashboards", "days_with_dashboards"),
    ("avg_total_activity", "total_activity"),
)
# Leadership period names.
PERIODS = ("this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year")


def account_lifecycle_signals(mart: DataFrame) -> DataFrame:
    """Q1/Q4/Q5: the labels of every account and month."""
    return mart.select(*ACCOUNT_SIGNAL_COLUMNS)


# ---------------------------------------------------------------- retention (Q2/Q3)


def _lookback_start(as_of: dt.date, rules: Rules) -> Column:
    return F.add_months(as_of_month(as_of), -rules.lookback_months)


def account_outcomes(mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules()) -> DataFrame:
    """One row per billing account: first churn month, first contraction month, and the
    activity of its established rows inside the look-back window (NULL when it has none).

    A single partial aggregation by account replaces the three sub-queries and the
    NOT IN anti-joins of the SQL form; a hot account is combined map-side.
    """
    as_of = as_date(as_of)
    mv = F.col("arr_movement_type")
    in_lookback = (F.col("is_new_account") == 0) & (F.col("snapshot_month") >= _lookback_start(as_of, rules))
    return mart.groupBy("billing_account_id").agg(
        F.min(F.when(mv == F.lit("churned"), F.col("snapshot_month"))).alias("churn_month"),
        F.min(F.when(mv == F.lit("contraction"), F.col("snapshot_month"))).alias("contraction_month"),
        F.sum(F.when(in_lookback, F.col("total_activity"))).alias("total_activity_last_3_months"),
    )


def churned_accounts(mart: DataFrame) -> DataFrame:
    """First churn month of every account that ever churned (repeat churners: first one)."""
    return (
        mart.where(F.col("arr_movement_type") == F.lit("churned"))
        .groupBy("billing_account_id")
        .agg(F.min("snapshot_month").alias("churn_month"))
    )


def contracted_accounts(mart: DataFrame) -> DataFrame:
    """First contraction month of accounts that never churned."""
    mv = F.col("arr_movement_type")
    g = mart.groupBy("billing_account_id").agg(
        F.min(F.when(mv == F.lit("churned"), F.col("snapshot_month"))).alias("churn_month"),
        F.min(F.when(mv == F.lit("contraction"), F.col("snapshot_month"))).alias("contraction_month"),
    )
    return g.where(F.col("churn_month").isNull() & F.col("contraction_month").isNotNull()).select(
        "billing_account_id", "contraction_month"
    )


def retained_activity(
    mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules(), with_contracted: bool = True
) -> DataFrame:
    """Look-back activity of accounts that never churned (nor contracted, by default)."""
    o = account_outcomes(mart, as_of, rules)
    keep = F.col("churn_month").isNull() & F.col("total_activity_last_3_months").isNotNull()
    if with_contracted:
        keep = keep & F.col("contraction_month").isNull()
    return o.where(keep).select("billing_account_id", "total_activity_last_3_months")


def _status(with_contracted: bool) -> Column:
    churned = F.col("churn_month").isNotNull()
    contracted = F.col("contraction_month").isNotNull()
    retained = F.when(F.col("total_activity_last_3_months") == 0, F.lit("retained_inactive")).when(
        F.col("total_activity_last_3_months").isNotNull(), F.lit("retained_active")
    )
    if with_contracted:
        return F.when(churned, F.lit("churned")).when(contracted, F.lit("contracted")).otherwise(retained)
    return F.when(churned, F.lit("churned")).otherwise(retained)


def retention_cohorts(
    mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules(), with_contracted: bool = True
) -> DataFrame:
    """The cohort rows: established mart rows in the months before an account's first
    churn (or first contraction), or inside the look-back window for retained accounts.

    Each account's outcome is expanded to the few months it selects, so the join is on
    (account, month): a hot account's rows meet by month, not in one task, and the two keys
    are one struct, so that the outcomes' partitioning by account is not taken over. The
    months that any account can select, a few rows per calendar month, are broadcast and
    prune the month folders of the mart at run time."""
    selected = selected_months(mart, as_of, rules, with_contracted)
    rows = mart.where(F.col("is_new_account") == 0).select(
        "billing_account_id", "snapshot_month", "customer_segment", *COHORT_MEASURES
    )
    rows = rows.join(F.broadcast(_months_in_reach(mart, as_of, rules)), on="snapshot_month", how="left_semi")
    left, right = (F.struct(f"{t}.billing_account_id", f"{t}.snapshot_month") for t in ("r", "s"))
    j = rows.alias("r").join(selected.alias("s"), on=left == right, how="inner")
    return j.select("r.billing_account_id", "r.customer_segment", "s.retention_status", *[f"r.{c}" for c in COHORT_MEASURES])


def _months_in_reach(mart: DataFrame, as_of: dt.date | str, rules: Rules) -> DataFrame:
    """The months that a churn or contraction in the mart, or the look-back, can select."""
    month, none = F.col("snapshot_month"), F.array().cast("array<date>")
    seen = mart.groupBy(month).agg(F.max(flag(F.col("arr_movement_type").isin("churned", "contraction"))).alias("event"))
    before = F.array(*[F.add_months(month, -k) for k in range(1, rules.pre_event_months + 1)]).cast("array<date>")
    event, recent = F.col("event") == 1, month >= _lookback_start(as_date(as_of), rules)
    reach = F.concat(F.when(event, before).otherwise(none), F.when(recent, F.array(month)).otherwise(none))
    # the filter also tells the optimizer that this side is worth a pruning of the other
    return seen.where(event | recent).select(F.explode(reach).alias("snapshot_month"))


def selected_months(
    mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules(), with_contracted: bool = True
) -> DataFrame:
    """(account, month, retention_status): the ``pre_event_months`` before the first churn or
    contraction, or the look-back months up to the latest for retained accounts."""
    as_of = as_date(as_of)
    outcomes = account_outcomes(mart, as_of, rules).withColumn("retention_status", _status(with_contracted))
    status, latest = F.col("retention_status"), latest_month(mart)
    event = F.when(status == F.lit("churned"), F.col("churn_month")).when(status == F.lit("contracted"), F.col("contraction_month"))
    before = F.array(*[F.add_months(event, -k) for k in range(1, rules.pre_event_months + 1)]).cast("array<date>")
    start = _lookback_start(as_of, rules)
    back = F.when(latest >= start, F.sequence(start, latest, F.expr("interval 1 month")))
    months = F.when(status.startswith("retained_"), back).otherwise(before)
    chosen = outcomes.where(status.isin("churned", "contracted", "retained_active", "retained_inactive"))
    return chosen.select("billing_account_id", F.explode(months).alias("snapshot_month"), "retention_status")


def _profile(rows: DataFrame, keys: list[str], averages) -> DataFrame:
    # rates to nine decimals and whole counts: sums that don't depend on the order of rows
    mean = {"active_user_rate": exact_avg(F.col("active_user_rate"), 10**9)}
    aggs = [round_half_away(mean.get(src, F.sum(src) / F.count(src)), 2).alias(out) for out, src in averages]
    aggs.append(F.countDistinct("billing_account_id").alias("accounts"))
    return rows.groupBy(*keys).agg(*aggs)


def retention_analysis(
    mart: DataFrame, as_of: dt.date | str, rules: Rules = Rules(), with_contracted: bool = True
) -> DataFrame:
    """Q2/Q3: averages over cohort rows (account-app-months) by segment and status."""
    cohorts = retention_cohorts(mart, as_of, rules, with_contracted)
    return _profile(cohorts, ["customer_segment", "retention_status"], RETENTION_AVERAGES)


def pre_event_usage(mart: DataFrame, as_of: dt.date | str, status: str, rules: Rules = Rules()) -> DataFrame:
    """Cohort rows of one status (``churned`` or ``contracted``)."""
    return retention_cohorts(mart, as_of, rules).where(F.col("retention_status") == F.lit(status))


# ---------------------------------------------------------------- product insights (Q6)


def product_insights_monthly(mart: DataFrame) -> DataFrame:
    """Q6: averages of established rows by segment and month."""
    rows = mart.where(F.col("is_new_account") == 0)
    return _profile(rows, ["customer_segment", "snapshot_month"], INSIGHT_AVERAGES)


# ---------------------------------------------------------------- leadership (Q7)


def latest_month(mart: DataFrame) -> Column:
    """The latest snapshot month as a column expression.

    For the month-partitioned mart table it is a literal noted when the table was read
    back, so the period filters prune month folders at planning time; for any other
    DataFrame it is a scalar sub-query over the rows (one small job, no join)."""
    latest = latest_partition(mart, "snapshot_month")
    if latest is not None:
        return F.lit(latest)
    return mart.agg(F.max("snapshot_month")).scalar()


def period_flags(m: Column, last: Column, rolling_last_quarter: bool = False) -> dict[str, Column]:
    """Whether month ``m`` lies in each leadership period that ends with month ``last``; quarter
    and year periods are cut to the months elapsed in the latest quarter / year.

    "Last quarter" is quarter - 1 of the same year, as in the SQL, so it is empty when the
    latest month is in Q1; ``rolling_last_quarter=True`` takes the calendar quarter three
    months back instead (crossing the year boundary), as the report notes describe.
    """
    months_into_quarter = months_into_period(last, "QUARTER") + 1
    months_into_year = months_into_period(last, "YEAR") + 1
    same_year = F.year(m) == F.year(last)
    in_q_window = months_into_period(m, "QUARTER") < months_into_quarter
    in_y_window = months_into_period(m, "YEAR") < months_into_year
    if rolling_last_quarter:
        last_quarter = (F.trunc(m, "QUARTER") == F.trunc(F.add_months(last, -3), "QUARTER")) & in_q_window
    else:
        last_quarter = same_year & (F.quarter(m) == F.quarter(last) - 1) & in_q_window
    return {
        "this_month": m == last,
        "last_month": m == F.add_months(last, -1),
        "this_quarter": same_year & (F.quarter(m) == F.quarter(last)) & in_q_window,
        "last_quarter": last_quarter,
        "this_year": same_year & in_y_window,
        "last_year": (F.year(m) == F.year(last) - 1) & in_y_window,
    }


def _recent(mart: DataFrame, last: Column) -> DataFrame:
    """Only the latest two calendar years can fall in any period (a range on the month
    itself, so it prunes month folders when ``last`` is a literal)."""
    return mart.where(F.col("snapshot_month") >= F.make_date(F.year(last) - 1, F.lit(1), F.lit(1)))


def period_rows(mart: DataFrame, rolling_last_quarter: bool = False) -> DataFrame:
    """Mart rows labelled with every leadership period they fall in (a row may be in
    several; see ``period_flags``). The latest month is a scalar sub-query, computed once."""
    last = latest_month(mart)
    in_period = period_flags(F.col("snapshot_month"), last, rolling_last_quarter)
    names = F.array_compact(F.array(*[F.when(in_period[p], F.lit(p)) for p in PERIODS]))
    cols = [
        "billing_account_id",
        "customer_segment",
        "snapshot_month",
        "ending_arr",
        "arr_change",
        "active_users",
        "total_activity",
        "total_meetings",
        "lifecycle_segment",
        "is_expansion_ready",
    ]
    return _recent(mart, last).select(F.explode(names).alias("period_name"), *cols)


_ACCOUNT_FLAGS = ("healthy", "at_risk", "under_adopted", "expansion_ready")
_BILLING_MEASURES = ("ending_arr", "arr_change", "active_users", "total_activity", "total_meetings")


def _row_flags() -> dict[str, Column]:
    seg = F.col("lifecycle_segment")
    flags = {v: flag(seg == F.lit(v)) for v in ("healthy", "at_risk", "under_adopted")}
    return flags | {"expansion_ready": flag(F.col("is_expansion_ready") == 1)}


def leadership_summary(
    mart: DataFrame,
    rolling_last_quarter: bool = False,
    dedup_app_rows: bool = False,
    period_end_arr: bool = False,
) -> DataFrame:
    """Q7: per period and segment, plus an ``overall`` row per period, in which an account
    with two segments counts once.

    Options (off by default, the SQL's semantics): ``dedup_app_rows`` counts the
    billing-level measures once per account-month instead of once per app row;
    ``period_end_arr`` reports each account's ending ARR of its last month in the
    period (a balance) instead of the sum over months.
    """
    if not (dedup_app_rows or period_end_arr):
        return _summary_by_masks(mart, rolling_last_quarter)
    rows = period_rows(mart, rolling_last_quarter)
    by_segment, overall = ["period_name", "customer_segment"], ["period_name"]
    # billing-level measures repeat on every app row of an account-month: keep one
    months = rows.groupBy(*by_segment, "billing_account_id", "snapshot_month").agg(
        *[F.max(c).alias(c) for c in _BILLING_MEASURES],
        F.count(F.lit(1)).alias("app_rows"),
        *[F.max(c).alias(name) for name, c in _row_flags().items()],
    )
    all_months = months.groupBy(*overall, "billing_account_id", "snapshot_month").agg(
        *[F.max(c).alias(c) for c in (*_BILLING_MEASURES, *_ACCOUNT_FLAGS)], F.sum("app_rows").alias("app_rows")
    )
    weight = F.lit(1) if dedup_app_rows else F.col("app_rows")

    def per_account(frame: DataFrame, keys: list[str]) -> DataFrame:
        sums = {c: F.sum(F.col(c) * weight) for c in _BILLING_MEASURES} | {"row_count": F.sum(weight)}
        if period_end_arr:
            sums["ending_arr"] = F.max_by("ending_arr", "snapshot_month")
        return frame.groupBy(*keys, "billing_account_id").agg(
            F.lit(1).alias("accounts"),
            *[v.alias(c) for c, v in sums.items()],
            *[F.max(c).alias(c) for c in _ACCOUNT_FLAGS],
        )

    everyone = _summary(per_account(all_months, overall), overall).withColumn("customer_segment", F.lit("overall"))
    return _summary(per_account(months, by_segment), by_segment).unionByName(everyone)


# bits of a period in an account's mask: present, then one for each account flag
_MASK_BITS = 1 + len(_ACCOUNT_FLAGS)


def _summary_by_masks(mart: DataFrame, rolling_last_quarter: bool) -> DataFrame:
    """Exact distinct counts from masks that merge by OR.

    A row's mask has, for each period it lies in, a bit for being there and one for each of
    its flags (6 x 5 bits, one int). An account's mask is the OR over its rows, whichever tasks
    they lie in, so one narrow row per account is shuffled, however many periods it is in, and
    its total over segments is one more group of the same aggregate. Measures need no account:
    they are summed by month and segment, the third grouping set of the one pass.
    """
    last = latest_month(mart)
    in_period = period_flags(F.col("snapshot_month"), last, rolling_last_quarter)
    keys = ("billing_account_id", "customer_segment", "snapshot_month")
    rows = _recent(mart, last).select(
        *keys, *_BILLING_MEASURES, *[c.alias(p) for p, c in in_period.items()], *[c.alias(f) for f, c in _row_flags().items()]
    )
    # both factors are sums of powers of two and no two products meet: nothing is carried
    periods = " + ".join(f"if({p}, {1 << _MASK_BITS * i}, 0)" for i, p in enumerate(PERIODS))
    bits = " + ".join(f"{2 << k} * {f}" for k, f in enumerate(_ACCOUNT_FLAGS))
    rows = rows.selectExpr(*keys, *_BILLING_MEASURES, f"({periods}) * (1 + {bits}) AS mask")
    in_segment, in_any, measured = keys[:2], keys[:1], keys[1:]
    groups = rows.groupingSets([in_segment, in_any, measured], *keys).agg(
        F.grouping("billing_account_id").alias("is_measured"),
        F.grouping("customer_segment").alias("is_total"),
        F.bit_or("mask").alias("mask"),
        *[F.sum(c).alias(c) for c in _BILLING_MEASURES],
        F.count(F.lit(1)).alias("row_count"),
    )
    each = groups.selectExpr("*", f"explode(sequence(0, {len(PERIODS) - 1})) AS period").where(
        f"bit_get(mask, {_MASK_BITS} * period) = 1"
    )
    # an account of a segment counts there, an account of any segment in the total, a measure in both
    parts = each.selectExpr(
        "period",
        "customer_segment",
        "explode(if(is_measured = 0, array(is_total = 1), array(false, true))) AS _all",
        *[
            f"if(is_measured = 0, int(bit_get(mask, {_MASK_BITS} * period + {k})), NULL) AS {c}"
            for k, c in enumerate(("accounts", *_ACCOUNT_FLAGS))
        ],
        *[f"if(is_measured = 1, {c}, NULL) AS {c}" for c in (*_BILLING_MEASURES, "row_count")],
    ).withColumn("customer_segment", F.expr("if(_all, 'overall', customer_segment)"))
    out = _summary(parts, ["period", "customer_segment", "_all"]).drop("_all")
    names = ", ".join(f"'{p}'" for p in PERIODS)
    return out.withColumn("period", F.expr(f"array({names})[period]")).withColumnRenamed("period", "period_name")


def _summary(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Totals over ``keys`` of rows that hold accounts (counted once each), measures or both."""
    return frame.groupBy(*keys).agg(
        F.sum("accounts").alias("total_accounts"),
        round_half_away(F.sum("ending_arr"), 2).alias("ending_arr"),
        round_half_away(F.sum("arr_change"), 2).alias("arr_change"),
        round_half_away(F.sum("active_users") / F.sum("row_count"), 2).alias("avg_active_users"),
        round_half_away(F.sum("total_activity"), 2).alias("total_activity"),
        round_half_away(F.sum("total_meetings"), 2).alias("total_meetings"),
        *[F.sum(c).alias(c) for c in _ACCOUNT_FLAGS],
    )


# ---------------------------------------------------------------- label views


def lifecycle_breakdown(mart: DataFrame) -> DataFrame:
    """Distinct accounts per month, segment and recommended action."""
    return mart.groupBy("snapshot_month", "lifecycle_segment", "recommended_action").agg(
        F.countDistinct("billing_account_id").alias("accounts")
    )


def label_domains(mart: DataFrame) -> DataFrame:
    """The distinct values each label column takes, as (label_name, label_value)."""
    labels = ("lifecycle_segment", "is_expansion_ready", "recommended_action", "reason_code")
    pairs = F.array(
        *[F.struct(F.lit(c).alias("label_name"), F.col(c).cast("string").alias("label_value")) for c in labels]
    )
    return mart.select(F.explode(pairs).alias("p")).select("p.label_name", "p.label_value").distinct()


def label_counts(mart: DataFrame, label: str) -> DataFrame:
    """Mart rows and distinct accounts per value of one label column."""
    return mart.groupBy(label).agg(
        F.count(F.lit(1)).alias("mart_rows"), F.countDistinct("billing_account_id").alias("accounts")
    )
