"""Every query this package implements, keyed by name, as ``(spark, sf_dir) -> DataFrame``.

Queries read the driver's tables through the source mapping; reports read the
lifecycle mart, which is written once per (checkpoint folder, tables, as_of)
and then shared by every report.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import signals as sig
from ledgerline.operators.staging import Staged, staging_row_counts
from ledgerline.plans import profile, quality, reports
from ledgerline.plans.mart import SCORE_COLUMNS, Models, build_models, materialized_mart
from ledgerline.rules import Rules
from ledgerline.session import bound_tasks
from ledgerline.sources.files import Sources
from ledgerline.sources.testdata import inputs_key, largest_input, testdata_sources

# Run date for the driver's tables (their orders end 2001-08-01).
AS_OF = dt.date(2001, 8, 1)


@dataclass
class Context:
    spark: SparkSession
    sf_dir: str
    as_of: dt.date = AS_OF
    rules: Rules = Rules()

    @cached_property
    def src(self) -> Sources:
        bound_tasks(self.spark, largest_input(self.spark, self.sf_dir))
        return testdata_sources(self.spark, self.sf_dir, materialized=True)

    @cached_property
    def models(self) -> Models:
        return build_models(self.src)

    @property
    def st(self) -> Staged:
        return self.models.staged

    @cached_property
    def mart(self) -> DataFrame:
        return materialized_mart(self.src, self.as_of, f"testdata:{inputs_key(self.spark, self.sf_dir)}", self.rules)


def _q(fn: Callable[[Context], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Context(spark, sf_dir))

    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _arr_signals(c: Context) -> DataFrame:
    return sig.arr_signals(c.models.arr_monthly)


TRAILING = Rules(trailing_expansion=True)


def _trailing(c: Context) -> Context:
    """The same source tables with the trailing-expansion option (its own written mart)."""
    t = Context(c.spark, c.sf_dir, c.as_of, TRAILING)
    t.__dict__["src"] = c.src
    return t


QUERIES: dict[str, Callable[[Context], DataFrame]] = {
    # staging
    "stg_billing_accounts": lambda c: c.st.billing_accounts,
    "stg_app_accounts": lambda c: c.st.app_accounts,
    "stg_app_users": lambda c: c.st.app_users,
    "stg_usage_daily": lambda c: c.st.usage_daily,
    "stg_arr_daily": lambda c: c.st.arr_daily,
    "staging_row_counts": lambda c: staging_row_counts(c.st),
    # intermediate
    "int_account_bridge": lambda c: c.models.bridge,
    "int_arr_monthly": lambda c: c.models.arr_monthly,
    "int_usage_monthly": lambda c: c.models.usage_monthly,
    "int_user_adoption_monthly": lambda c: c.models.adoption_monthly,
    # mart building blocks
    "account_spine": lambda c: sig.account_spine(c.models.bridge, c.st.billing_accounts, c.st.arr_daily),
    "arr_signals": _arr_signals,
    "usage_by_billing_month": lambda c: sig.usage_by_billing_month(c.models.usage_monthly, c.models.bridge),
    "adoption_by_billing_month": lambda c: sig.adoption_by_billing_month(c.models.adoption_monthly, c.models.bridge),
    "expansion_signals": lambda c: sig.expansion_signals(c.models.arr_monthly, c.as_of, c.rules),
    "segment_scores": lambda c: c.mart.select(*SCORE_COLUMNS),
    "mart_account_lifecycle_monthly": lambda c: c.mart,
    "lifecycle_segment": lambda c: reports.label_counts(c.mart, "lifecycle_segment"),
    "expansion_ready": lambda c: reports.label_counts(c.mart, "is_expansion_ready"),
    "reason_code": lambda c: reports.label_counts(c.mart, "reason_code"),
    "recommended_action": lambda c: reports.label_counts(c.mart, "recommended_action"),
    # reports
    "account_lifecycle_signals": lambda c: reports.account_lifecycle_signals(c.mart),
    "churned_accounts": lambda c: reports.churned_accounts(c.mart),
    "contracted_accounts": lambda c: reports.contracted_accounts(c.mart),
    "retained_activity": lambda c: reports.retained_activity(c.mart, c.as_of, c.rules),
    "pre_churn_usage": lambda c: reports.pre_event_usage(c.mart, c.as_of, "churned", c.rules),
    "pre_contraction_usage": lambda c: reports.pre_event_usage(c.mart, c.as_of, "contracted", c.rules),
    "retention_cohorts": lambda c: reports.retention_cohorts(c.mart, c.as_of, c.rules),
    "retention_analysis": lambda c: reports.retention_analysis(c.mart, c.as_of, c.rules),
    "retention_analysis_3way": lambda c: reports.retention_analysis(c.mart, c.as_of, c.rules, with_contracted=False),
    "product_insights_monthly": lambda c: reports.product_insights_monthly(c.mart),
    "period_rows": lambda c: reports.period_rows(c.mart),
    "leadership_summary": lambda c: reports.leadership_summary(c.mart),
    "lifecycle_breakdown": lambda c: reports.lifecycle_breakdown(c.mart),
    "label_domains": lambda c: reports.label_domains(c.mart),
    # options off by default, described in the metric notes (each has its own oracle)
    "expansion_signals_trailing": lambda c: sig.expansion_signals(c.models.arr_monthly, c.as_of, TRAILING),
    "account_lifecycle_signals_trailing": lambda c: reports.account_lifecycle_signals(_trailing(c).mart),
    "leadership_summary_rolling_quarter": lambda c: reports.leadership_summary(c.mart, rolling_last_quarter=True),
    "leadership_summary_dedup": lambda c: reports.leadership_summary(c.mart, dedup_app_rows=True),
    "leadership_summary_period_end_arr": lambda c: reports.leadership_summary(c.mart, period_end_arr=True),
    # data quality
    "dq_unmatched_billing": lambda c: quality.dq_unmatched_billing(c.st),
    "dq_duplicate_bridge": lambda c: quality.dq_duplicate_bridge(c.models.bridge),
    "dq_repeat_churn": lambda c: quality.dq_repeat_churn(c.mart),
    "dq_usage_after_zero_arr": lambda c: quality.dq_usage_after_zero_arr(c.mart),
    "dq_zero_usage_retained": lambda c: quality.dq_zero_usage_retained(c.mart, c.as_of, c.rules),
    "dq_multi_movement": lambda c: quality.dq_multi_movement(c.st.arr_daily),
    "dq_multi_movement_first_last": lambda c: quality.dq_multi_movement_first_last(c.models.arr_monthly),
    "dq_unique_keys": lambda c: quality.dq_unique_keys(c.st, c.models.bridge, c.models.arr_monthly),
    "dq_not_null": lambda c: quality.dq_not_null(c.st, c.mart),
    "dq_accepted_values": lambda c: quality.dq_accepted_values(c.mart),
    # profiling
    "multi_app_accounts": lambda c: profile.multi_app_accounts(c.src),
    "bridge_profile": lambda c: profile.bridge_profile(c.src),
    "arr_movement_by_month": lambda c: profile.arr_movement_by_month(c.models.arr_monthly),
    "arr_movement_counts": lambda c: profile.arr_movement_counts(c.models.arr_monthly),
    "arr_profile": lambda c: profile.arr_profile(c.src),
    "zero_arr_rows_sample": lambda c: profile.zero_arr_rows_sample(c.src),
    "zero_usage_app_accounts": lambda c: profile.zero_usage_app_accounts(c.src),
    "zero_usage_by_signup_month": lambda c: profile.zero_usage_by_signup_month(c.src),
    "utilisation_buckets": lambda c: profile.utilisation_buckets(c.src),
    "utilisation_buckets_fine": lambda c: profile.utilisation_buckets_fine(c.src),
    "co_adoption": lambda c: profile.co_adoption(c.src),
    "segment_counts": lambda c: profile.segment_counts(c.src),
    "internal_counts": lambda c: profile.internal_counts(c.src),
    "seat_tier_top10": lambda c: profile.seat_tier_top10(c.src),
    "arr_overview": lambda c: profile.arr_overview(c.src),
    "usage_overview": lambda c: profile.usage_overview(c.src),
    "names_per_bridge": lambda c: profile.names_per_bridge(c.src),
    "distinct_billing_names": lambda c: profile.distinct_billing_names(c.src),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _q(fn) for name, fn in QUERIES.items()}
