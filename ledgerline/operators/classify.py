"""Rule classifiers of the lifecycle mart: first matching rule wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.rules import Rules

# Label domains of the four rule columns.
LIFECYCLE_SEGMENTS = ("new", "healthy", "at_risk", "under_adopted", "unknown")
REASON_CODES = (
    "new_account",
    "churned",
    "recent_contraction",
    "zero_active_users",
    "low_active_user_rate",
    "usage_declining",
    "healthy_usage_and_arr",
    "recently_expanded",
    "stable_moderate_usage",
)
RECOMMENDED_ACTIONS = (
    "monitor_activation",
    "churn_review",
    "cs_outreach_contraction",
    "cs_outreach_no_usage",
    "cs_outreach_low_adoption",
    "cs_outreach_declining",
    "gtm_expansion_outreach",
    "nurture",
    "monitor",
)
STEADY_OR_GROWING = ("stable", "expansion")


class _Signals:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.rate = F.col("active_user_rate")
        self.prev = F.col("prev_month_active_user_rate")
        self.mv = F.col("arr_movement_type")
        self.is_new = F.col("is_new_account") == 1

    def declining(self) -> Column:
        return self.prev.isNotNull() & (self.rate < self.prev * F.lit(self.rules.decline_factor))

    def healthy_usage(self) -> Column:
        return (self.rate >= F.lit(self.rules.healthy_rate)) & self.mv.isin(*STEADY_OR_GROWING)

    def low_rate(self) -> Column:
        return self.rate < F.lit(self.rules.at_risk_rate)


def lifecycle_segment(rules: Rules = Rules()) -> Column:
    s = _Signals(rules)
    not_declining = s.prev.isNull() | (s.rate >= s.prev * F.lit(rules.decline_factor))
    return (
        F.when(s.is_new, F.lit("new"))
        .when(s.healthy_usage() & not_declining, F.lit("healthy"))
        .when(s.low_rate() | (s.mv == F.lit("contraction")) | s.declining(), F.lit("at_risk"))
        .when(s.rate >= F.lit(rules.at_risk_rate), F.lit("under_adopted"))
        .otherwise(F.lit("unknown"))
    )


def is_expansion_ready(rules: Rules = Rules()) -> Column:
    """Independent of the segment: established, no recent expansion, active, high rate, meetings."""
    cond = (
        (F.col("is_new_account") == 0)
        & (F.col("expanded_last_3_months") == 0)
        & (F.col("total_activity") > 0)
        & (F.col("active_user_rate") >= F.lit(rules.healthy_rate))
        & (F.col("total_meetings") > 0)
    )
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def reason_code(rules: Rules = Rules()) -> Column:
    s = _Signals(rules)
    return (
        F.when(s.is_new, F.lit("new_account"))
        .when(s.mv == F.lit("churned"), F.lit("churned"))
        .when(s.mv == F.lit("contraction"), F.lit("recent_contraction"))
        .when(s.rate == 0, F.lit("zero_active_users"))
        .when(s.low_rate(), F.lit("low_active_user_rate"))
        .when(s.declining(), F.lit("usage_declining"))
        .when(s.healthy_usage(), F.lit("healthy_usage_and_arr"))
        .when(F.col("expanded_last_3_months") == 1, F.lit("recently_expanded"))
        .otherwise(F.lit("stable_moderate_usage"))
    )


def recommended_action(rules: Rules = Rules()) -> Column:
    """Reads ``is_expansion_ready``, so it is applied after that column exists."""
    s = _Signals(rules)
    return (
        F.when(s.is_new, F.lit("monitor_activation"))
        .when(s.mv == F.lit("churned"), F.lit("churn_review"))
        .when(s.mv == F.lit("contraction"), F.lit("cs_outreach_contraction"))
        .when(s.rate == 0, F.lit("cs_outreach_no_usage"))
        .when(s.low_rate(), F.lit("cs_outreach_low_adoption"))
        .when(s.declining(), F.lit("cs_outreach_declining"))
        .when(F.col("is_expansion_ready") == 1, F.lit("gtm_expansion_outreach"))
        .when(s.healthy_usage(), F.lit("nurture"))
        .otherwise(F.lit("monitor"))
    )
