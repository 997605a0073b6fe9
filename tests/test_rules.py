"""Every branch of the rule classifiers, and the threshold sides, on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.intermediate import int_arr_monthly
from ledgerline.operators.staging import stg_arr_daily
from ledgerline.plans.mart import add_labels
from tests.conftest import D, arr_row, make_sources

SCHEMA = T.StructType(
    [
        T.StructField("case", T.StringType()),
        T.StructField("is_new_account", T.IntegerType()),
        T.StructField("active_user_rate", T.DoubleType()),
        T.StructField("prev_month_active_user_rate", T.DoubleType()),
        T.StructField("arr_movement_type", T.StringType()),
        T.StructField("expanded_last_3_months", T.IntegerType()),
        T.StructField("total_activity", T.LongType()),
        T.StructField("total_meetings", T.LongType()),
    ]
)

# case, new, rate, prev, movement, expanded_last_3, activity, meetings -> segment, ready, reason, action
CASES = [
    (("new", 1, 0.9, None, "stable", 0, 10, 1), ("new", 0, "new_account", "monitor_activation")),
    (("healthy_ready", 0, 0.8, None, "stable", 0, 10, 1), ("healthy", 1, "healthy_usage_and_arr", "gtm_expansion_outreach")),
    (("healthy_no_meetings", 0, 0.8, None, "expansion", 0, 10, 0), ("healthy", 0, "healthy_usage_and_arr", "nurture")),
    (("declining", 0, 0.9, 1.0, "stable", 0, 10, 1), ("at_risk", 1, "usage_declining", "cs_outreach_declining")),
    (("decline_exactly_2pct", 0, 0.98, 1.0, "stable", 0, 10, 0), ("healthy", 0, "healthy_usage_and_arr", "nurture")),
    (("rate_exactly_060", 0, 0.6, None, "stable", 0, 10, 1), ("under_adopted", 0, "stable_moderate_usage", "monitor")),
    (("rate_below_060", 0, 0.59, None, "stable", 0, 10, 1), ("at_risk", 0, "low_active_user_rate", "cs_outreach_low_adoption")),
    (("zero_rate", 0, 0.0, None, "stable", 0, 0, 0), ("at_risk", 0, "zero_active_users", "cs_outreach_no_usage")),
    (("churned_full_rate", 0, 1.0, None, "churned", 0, 10, 1), ("under_adopted", 1, "churned", "churn_review")),
    (("contraction", 0, 0.9, None, "contraction", 0, 10, 1), ("at_risk", 1, "recent_contraction", "cs_outreach_contraction")),
    (("recently_expanded", 0, 0.7, None, "expansion", 1, 10, 1), ("under_adopted", 0, "recently_expanded", "monitor")),
    (("ready_not_healthy", 0, 0.9, None, "unknown", 0, 10, 1), ("under_adopted", 1, "stable_moderate_usage", "gtm_expansion_outreach")),
    (("healthy_recent_expansion", 0, 0.85, None, "stable", 1, 10, 1), ("healthy", 0, "healthy_usage_and_arr", "nurture")),
]


@pytest.fixture(scope="module")
def labelled(spark):
    df = spark.createDataFrame([c for c, _ in CASES], SCHEMA)
    out = add_labels(df).select("case", "lifecycle_segment", "is_expansion_ready", "reason_code", "recommended_action")
    return {r["case"]: tuple(r)[1:] for r in out.collect()}


@pytest.mark.parametrize("case,expected", [(c[0], e) for c, e in CASES])
def test_rule_branch(labelled, case, expected):
    assert labelled[case] == expected


def test_arr_movement_types(spark):
    jan = D(2024, 1, 1)
    rows = [
        arr_row(jan, 1, 100, 100), arr_row(D(2024, 1, 15), 1, 100, 0),  # churned
        arr_row(jan, 2, 100, 200),  # expansion
        arr_row(jan, 3, 200, 100),  # contraction
        arr_row(jan, 4, 100, 100),  # stable
        arr_row(jan, 5, 100, None),  # NULL last ending -> unknown
        arr_row(jan, 6, 100, 0), arr_row(D(2024, 1, 20), 6, 0, 100),  # mid-month zero, recovery: first/last -> stable
        arr_row(jan, 7, None, 50), arr_row(D(2024, 1, 9), 7, 50, 50),  # NULL first starting kept -> unknown
        arr_row(jan, 8, 0, 0),  # zero to zero -> stable
    ]
    src = make_sources(spark, arr=rows)
    got = {r["billing_account_id"]: r for r in int_arr_monthly(stg_arr_daily(src.arr_daily)).collect()}
    assert {k: v["arr_movement_type"] for k, v in got.items()} == {
        1: "churned",
        2: "expansion",
        3: "contraction",
        4: "stable",
        5: "unknown",
        6: "stable",
        7: "unknown",
        8: "stable",
    }
    assert got[7]["starting_arr"] is None and got[7]["ending_arr"] == 50.0
    assert got[1]["arr_change"] == -100.0
    assert all(v["snapshot_month"] == jan for v in got.values())


def test_decline_threshold_is_strict(spark):
    """0.98 * previous is still not declining; just below it is."""
    df = spark.createDataFrame(
        [("a", 0, 0.49, 0.5, "stable", 0, 1, 1), ("b", 0, 0.98, 1.0, "stable", 0, 1, 1)], SCHEMA
    )
    out = {r["case"]: r["reason_code"] for r in add_labels(df).select("case", "reason_code").collect()}
    assert out["b"] == "healthy_usage_and_arr"
    assert out["a"] == "low_active_user_rate"  # below 0.60 wins before declining
    assert add_labels(df).where(F.col("lifecycle_segment") == "unknown").count() == 0
