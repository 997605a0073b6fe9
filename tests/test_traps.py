"""Semantic traps of the reference models, pinned on hand-made source tables."""

from __future__ import annotations

import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.numeric import round_half_away
from ledgerline.operators.staging import stage
from ledgerline.plans import profile, quality, reports
from ledgerline.plans.mart import build_models, lifecycle_mart
from ledgerline.sources.files import read_csv_sources
from tests.conftest import D, app, arr_row, billing, make_sources, usage_row, user

AS_OF = D(2024, 4, 1)


def months(bid, first: dt.date, n: int, arr=1200.0):
    """One ARR row per month start for ``n`` months, constant ARR."""
    out = []
    y, m = first.year, first.month
    for _ in range(n):
        out.append(arr_row(D(y, m, 1), bid, arr, arr))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def mart_of(spark, as_of=AS_OF, **tables):
    return lifecycle_mart(build_models(make_sources(spark, **tables)), as_of)


def test_null_month_row_is_not_previous_month(spark):
    """A user without usage gives a NULL-month adoption row; it must not become the
    previous month of the first real month (T1), and a month without usage has no
    previous rate either (T16)."""
    mart = mart_of(
        spark,
        billing=[billing(1, bridge=1, created=D(2020, 1, 1))],
        apps=[app(1, 1, signup=D(2020, 1, 1))],
        users=[user(10, 1), user(11, 1)],  # user 11 never uses the product
        usage=[usage_row(D(2024, 1, 5), 10, meeting_count=1), usage_row(D(2024, 2, 5), 10, meeting_count=1)],
        arr=months(1, D(2024, 1, 1), 3),
    )
    got = {r["snapshot_month"]: r for r in mart.collect()}
    assert got[D(2024, 1, 1)]["prev_month_active_user_rate"] is None
    assert got[D(2024, 1, 1)]["active_user_rate"] == 1.0
    assert got[D(2024, 2, 1)]["prev_month_active_user_rate"] == 1.0
    assert got[D(2024, 3, 1)]["active_user_rate"] == 0.0
    assert got[D(2024, 3, 1)]["prev_month_active_user_rate"] is None
    assert got[D(2024, 3, 1)]["lifecycle_segment"] == "at_risk"
    assert got[D(2024, 3, 1)]["reason_code"] == "zero_active_users"


def test_null_counter_nulls_row_total_only(spark):
    """A NULL counter makes that row's total NULL (adds 0 to total_activity) but the
    other counters still add to their own totals (T7)."""
    src = make_sources(
        spark,
        users=[user(10, 1)],
        usage=[
            usage_row(D(2024, 1, 5), 10, meeting_count=None, page_view_count=3),
            usage_row(D(2024, 1, 6), 10, meeting_count=2, page_view_count=1),
        ],
    )
    st = stage(src)
    totals = [r["total_activity"] for r in st.usage_daily.orderBy("date").collect()]
    assert totals == [None, 3]
    m = build_models(src)
    row = m.usage_monthly.collect()[0]
    assert row["total_meetings"] == 2
    assert row["total_page_views"] == 4
    assert row["total_activity"] == 3
    ad = m.adoption_monthly.where(F.col("snapshot_month").isNotNull()).collect()[0]
    assert ad["days_with_meetings"] == 1 and ad["days_with_page_views"] == 2
    assert ad["active_users"] == 1


def test_rounding_is_on_binary_doubles(spark):
    """round(x, 2) scales the double first: 1.005 -> 1.0 (T4), unlike rounding its
    decimal text; exact halves go away from zero. Checked against SQL's round."""
    import duckdb

    values = [1.005, 0.125, -0.125, 2.675, 0.285, 1.115, 0.745, -2.5, 1234.5675]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(round_half_away(F.col("x"), 2)).collect()]
    sql = duckdb.sql("SELECT " + ", ".join(f"round({v}::DOUBLE, 2)" for v in values)).fetchall()[0]
    assert got == list(sql)
    assert got[0] == 1.0


def test_unweighted_rate_and_app_fan_out(spark):
    """Two app accounts with rates 1.0 and 0.5: billing rate is their plain mean (T10),
    and the billing-level measures repeat on both app rows (T11)."""
    mart = mart_of(
        spark,
        billing=[billing(1, bridge=1, created=D(2020, 1, 1))],
        apps=[app(1, 1, signup=D(2020, 1, 1)), app(2, 1, signup=D(2020, 1, 1))],
        users=[user(10, 1), user(20, 2), user(21, 2)],
        usage=[
            usage_row(D(2024, 1, 5), 10, meeting_count=1),
            usage_row(D(2024, 1, 5), 20, meeting_count=2),
            usage_row(D(2024, 1, 5), 21),  # a row with all counters 0: not active
        ],
        arr=[arr_row(D(2024, 1, 1), 1, 1000, 1000)],
    )
    rows = mart.collect()
    assert sorted(r["app_account_id"] for r in rows) == [1, 2]
    for r in rows:
        assert r["active_user_rate"] == pytest.approx(0.75)
        assert r["total_meetings"] == 3
        assert r["total_users"] == 3 and r["active_users"] == 2
    summary = reports.leadership_summary(mart).where(
        (F.col("period_name") == "this_month") & (F.col("customer_segment") == "overall")
    ).collect()[0]
    assert summary["ending_arr"] == 2000.0  # the account's ARR counted once per app row
    assert summary["total_accounts"] == 1


def test_new_account_flag(spark):
    """Month <= month(signup or creation + 30 days); months before signup are new; no
    dates -> not new."""
    mart = mart_of(
        spark,
        billing=[
            billing(1, bridge=1, created=D(2019, 1, 1)),
            billing(2, bridge=None, created=D(2024, 1, 25)),
            billing(3, bridge=None, created=None),
        ],
        apps=[app(1, 1, signup=D(2024, 2, 10))],
        arr=months(1, D(2024, 1, 1), 4) + months(2, D(2024, 1, 1), 4) + months(3, D(2024, 1, 1), 2),
    )
    got = {(r["billing_account_id"], r["snapshot_month"].month): r["is_new_account"] for r in mart.collect()}
    # account 1: signup 2024-02-10 + 30 days = 2024-03-11 -> new through March (January is before signup)
    assert [got[(1, m)] for m in (1, 2, 3, 4)] == [1, 1, 1, 0]
    # account 2: no app, created 2024-01-25 + 30 days = 2024-02-24 -> new through February
    assert [got[(2, m)] for m in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert [got[(3, m)] for m in (1, 2)] == [0, 0]


def test_recent_expansion_flag_is_own_month_only(spark):
    """The flag is set on the expansion month itself when it is recent (D1 as written):
    the month after an expansion is not flagged."""
    arr = [
        arr_row(D(2024, 1, 1), 1, 1000, 2000),  # expansion, recent (>= 2024-01 for as_of 2024-04)
        arr_row(D(2024, 2, 1), 1, 2000, 2000),  # stable
        arr_row(D(2023, 6, 1), 1, 500, 1000),  # expansion, not recent
    ]
    mart = mart_of(spark, billing=[billing(1, bridge=None, created=D(2020, 1, 1))], arr=arr)
    got = {r["snapshot_month"]: (r["had_expansion"], r["expanded_last_3_months"]) for r in mart.collect()}
    assert got == {D(2024, 1, 1): (1, 1), D(2024, 2, 1): (0, 0), D(2023, 6, 1): (1, 0)}


def test_internal_null_flag_is_excluded(spark):
    src = make_sources(
        spark,
        apps=[app(1, 1, internal=False), app(2, 2, internal=None), app(3, 3, internal=True)],
        users=[user(10, 1, internal=None), user(11, 1, internal=False)],
    )
    st = stage(src)
    assert [r[0] for r in st.app_accounts.select("app_account_id").collect()] == [1]
    assert [r[0] for r in st.app_users.select("app_user_id").collect()] == [11]


def test_null_segment_stays_apart_from_overall(spark):
    mart = mart_of(
        spark,
        billing=[billing(1, segment=None, created=D(2020, 1, 1)), billing(2, segment="Large", created=D(2020, 1, 1))],
        arr=[arr_row(D(2024, 3, 1), 1, 100, 100), arr_row(D(2024, 3, 1), 2, 300, 300)],
    )
    got = {
        (r["customer_segment"]): (r["total_accounts"], r["ending_arr"])
        for r in reports.leadership_summary(mart).where(F.col("period_name") == "this_month").collect()
    }
    assert got == {None: (1, 100.0), "Large": (1, 300.0), "overall": (2, 400.0)}


def test_last_quarter_is_empty_in_january(spark):
    """Latest month in Q1: quarter - 1 of the same year matches nothing (D7 as written)."""
    arr = months(1, D(2022, 11, 1), 15)  # 2022-11 .. 2024-01
    mart = mart_of(spark, billing=[billing(1, created=D(2020, 1, 1))], arr=arr)
    periods = {}
    for r in reports.period_rows(mart).collect():
        periods.setdefault(r["period_name"], set()).add(r["snapshot_month"])
    assert "last_quarter" not in periods
    assert periods["this_month"] == {D(2024, 1, 1)}
    assert periods["this_quarter"] == {D(2024, 1, 1)}
    assert periods["last_month"] == {D(2023, 12, 1)}
    assert periods["this_year"] == {D(2024, 1, 1)}
    assert periods["last_year"] == {D(2023, 1, 1)}


def test_quarter_periods_cut_to_elapsed_months(spark):
    arr = months(1, D(2023, 1, 1), 20)  # 2023-01 .. 2024-08
    mart = mart_of(spark, billing=[billing(1, created=D(2020, 1, 1))], arr=arr)
    periods = {}
    for r in reports.period_rows(mart).collect():
        periods.setdefault(r["period_name"], set()).add(r["snapshot_month"].month * (1 if r["snapshot_month"].year == 2024 else -1))
    assert periods["this_quarter"] == {7, 8}
    assert periods["last_quarter"] == {4, 5}
    assert periods["this_year"] == set(range(1, 9))
    assert periods["last_year"] == {-m for m in range(1, 9)}


def test_first_churn_month_is_used(spark):
    """Churn, return, churn again: the first churn month defines the cohort."""
    arr = [
        arr_row(D(2023, 10, 1), 1, 100, 100),
        arr_row(D(2023, 11, 1), 1, 100, 100),
        arr_row(D(2023, 12, 1), 1, 100, 0),  # churn
        arr_row(D(2024, 1, 1), 1, 0, 100),  # return
        arr_row(D(2024, 2, 1), 1, 100, 0),  # churn again
    ]
    mart = mart_of(spark, billing=[billing(1, created=D(2020, 1, 1))], arr=arr)
    assert [tuple(r) for r in reports.churned_accounts(mart).collect()] == [(1, D(2023, 12, 1))]
    rc = quality.dq_repeat_churn(mart).collect()[0]
    assert (rc["churn_months"], rc["first_churn_month"], rc["last_churn_month"]) == (2, D(2023, 12, 1), D(2024, 2, 1))
    cohort = reports.retention_cohorts(mart, AS_OF).collect()
    assert {r["retention_status"] for r in cohort} == {"churned"}
    assert len(cohort) == 2  # 2023-10 and 2023-11: the rows in the three months before 2023-12


def test_retained_split_and_contracted_exclusion(spark):
    arr = (
        [arr_row(D(2024, 1, 1), 1, 100, 100), arr_row(D(2024, 2, 1), 1, 100, 100)]  # retained
        + [arr_row(D(2024, 1, 1), 2, 100, 100), arr_row(D(2024, 2, 1), 2, 100, 50)]  # contracted
    )
    mart = mart_of(
        spark,
        billing=[billing(1, bridge=1, created=D(2020, 1, 1)), billing(2, created=D(2020, 1, 1))],
        apps=[app(1, 1, signup=D(2020, 1, 1))],
        users=[user(10, 1)],
        usage=[usage_row(D(2024, 2, 3), 10, task_synced_count=4)],
        arr=arr,
    )
    four = {r["retention_status"]: r["accounts"] for r in reports.retention_analysis(mart, AS_OF).collect()}
    assert four == {"retained_active": 1, "contracted": 1}
    three = {
        r["retention_status"]: r["accounts"]
        for r in reports.retention_analysis(mart, AS_OF, with_contracted=False).collect()
    }
    # without the contracted bucket the contracted account is retained (inactive: no usage)
    assert three == {"retained_active": 1, "retained_inactive": 1}


def test_csv_reader_reads_doubled_quotes(spark, tmp_path):
    d = tmp_path / "src"
    d.mkdir()
    (d / "billing_accounts.csv").write_text(
        "billing_account_id,billing_account_name,billing_account_bridge_id,customer_segment,created_date\n"
        'b1,"Acme, ""East""",x1,Large,2024-01-05\n'
    )
    (d / "app_accounts.csv").write_text(
        "app_account_id,app_account_name,app_parent_account_id,app_root_account_id,billing_account_bridge_id,"
        "signup_date,trial_end_date,is_internal_account\n"
        "a1,App,,a1,x1,2024-01-06,,false\n"
    )
    (d / "app_users.csv").write_text(
        "app_user_id,app_user_name,app_account_id,seat_tiers_array,signup_date,is_account_owner,is_internal_user\n"
        'u1,Ann,a1,"[""pro"",""ai""]",2024-01-07,true,false\n'
    )
    (d / "app_usage_daily.csv").write_text(
        "date,app_user_id,meeting_count,page_view_count,page_visit_count,note_viewed_count,"
        "ai_chat_message_submitted_count,note_synced_count,dashboard_viewed_count,meeting_agenda_viewed_count,"
        "task_synced_count\n2024-01-08,u1,1,2,3,4,5,6,7,8,9\n"
    )
    (d / "arr_daily.csv").write_text("date,billing_account_id,starting_arr,ending_arr\n2024-01-08,b1,100,120\n")
    src = read_csv_sources(spark, str(d))
    assert src.billing_accounts.collect()[0]["billing_account_name"] == 'Acme, "East"'
    assert src.app_users.collect()[0]["seat_tiers_array"] == '["pro","ai"]'
    mart = lifecycle_mart(build_models(src), AS_OF)
    row = mart.collect()[0]
    assert (row["billing_account_id"], row["app_account_id"], row["total_activity"]) == ("b1", "a1", 45)
    assert row["arr_movement_type"] == "expansion"


def test_trailing_expansion_option(spark):
    """Opt-in: expansion in any of the three calendar months before the month."""
    from ledgerline.operators.intermediate import int_arr_monthly
    from ledgerline.operators.signals import expansion_signals
    from ledgerline.operators.staging import stg_arr_daily
    from ledgerline.rules import Rules

    arr = [arr_row(D(2024, 1, 1), 1, 100, 200)] + [arr_row(D(2024, m, 1), 1, 200, 200) for m in (2, 3, 4, 5)]
    monthly = int_arr_monthly(stg_arr_daily(make_sources(spark, arr=arr).arr_daily))
    got = {
        r["snapshot_month"].month: r["expanded_last_3_months"]
        for r in expansion_signals(monthly, AS_OF, Rules(trailing_expansion=True)).collect()
    }
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    default = {r["snapshot_month"].month: r["expanded_last_3_months"] for r in expansion_signals(monthly, AS_OF).collect()}
    assert default == {1: 1, 2: 0, 3: 0, 4: 0, 5: 0}


def test_rolling_last_quarter_option(spark):
    arr = months(1, D(2023, 9, 1), 5)  # 2023-09 .. 2024-01
    mart = mart_of(spark, billing=[billing(1, created=D(2020, 1, 1))], arr=arr)
    lq = {r["snapshot_month"] for r in reports.period_rows(mart, rolling_last_quarter=True).collect()
          if r["period_name"] == "last_quarter"}
    assert lq == {D(2023, 10, 1)}  # Q4 of the previous year, cut to one elapsed month


def test_dedup_and_period_end_options(spark):
    mart = mart_of(
        spark,
        billing=[billing(1, bridge=1, created=D(2020, 1, 1))],
        apps=[app(1, 1, signup=D(2020, 1, 1)), app(2, 1, signup=D(2020, 1, 1))],
        arr=[arr_row(D(2024, m, 1), 1, 100 * m, 100 * m) for m in (1, 2, 3)],
    )

    def this_year(**kw):
        return (
            reports.leadership_summary(mart, **kw)
            .where((F.col("period_name") == "this_year") & (F.col("customer_segment") == "overall"))
            .collect()[0]["ending_arr"]
        )

    assert this_year() == 1200.0  # (100 + 200 + 300) on each of two app rows
    assert this_year(dedup_app_rows=True) == 600.0
    assert this_year(period_end_arr=True) == 300.0  # the March balance, once per account


def test_zero_usage_app_accounts(spark):
    """App accounts whose users never had activity: no usage rows at all, only zero rows,
    or no users; internal accounts are left out."""
    from ledgerline.plans import profile

    src = make_sources(
        spark,
        apps=[
            app(1, 1, signup=D(2024, 1, 3)),  # active user
            app(2, 2, signup=D(2024, 1, 9)),  # user with only all-zero rows
            app(3, 3, signup=D(2024, 2, 1)),  # no users
            app(4, 4, signup=D(2024, 2, 5), internal=True),  # internal: not listed
            app(5, 5, signup=None),  # user without any usage row
        ],
        users=[user(10, 1), user(20, 2), user(50, 5), user(51, 1, internal=True)],
        usage=[usage_row(D(2024, 3, 1), 10, meeting_count=1), usage_row(D(2024, 3, 1), 20)],
    )
    got = sorted(r["app_account_id"] for r in profile.zero_usage_app_accounts(src).collect())
    assert got == [2, 3, 5]
    by_month = {r["signup_month"]: r["zero_usage_accounts"] for r in profile.zero_usage_by_signup_month(src).collect()}
    assert by_month == {D(2024, 1, 1): 1, D(2024, 2, 1): 1, None: 1}


def test_multi_movement_check_min_max_versus_first_last(spark):
    """The check as written uses min(start)/max(end) per month, which cannot see a churn
    (D9); the first/last variant sees the account's churn and contraction months."""
    from ledgerline.operators.intermediate import int_arr_monthly
    from ledgerline.operators.staging import stg_arr_daily

    arr = [
        arr_row(D(2024, 1, 1), 1, 300, 300), arr_row(D(2024, 1, 20), 1, 300, 0),  # first/last: churned
        arr_row(D(2024, 2, 1), 1, 0, 200), arr_row(D(2024, 2, 9), 1, 200, 100),  # first/last: expansion
        arr_row(D(2024, 3, 1), 1, 100, 50),  # contraction either way
    ]
    stg = stg_arr_daily(make_sources(spark, arr=arr).arr_daily)
    as_written = {r["billing_account_id"]: r for r in quality.dq_multi_movement(stg).collect()}
    first_last = {r["billing_account_id"]: r for r in quality.dq_multi_movement_first_last(int_arr_monthly(stg)).collect()}
    # min/max: Jan 300->300 stable, Feb 0->200 expansion, Mar contraction
    assert as_written[1]["movement_types"] == "contraction, expansion"
    assert first_last[1]["movement_types"] == "churned, contraction, expansion"
    assert first_last[1]["distinct_movement_types"] == 3


def test_new_account_window_crosses_the_year(spark):
    """Signup 2023-12-15 + 30 days = 2024-01-14: new through January 2024."""
    mart = mart_of(
        spark,
        billing=[billing(1, bridge=1, created=D(2020, 1, 1))],
        apps=[app(1, 1, signup=D(2023, 12, 15))],
        arr=months(1, D(2023, 11, 1), 4),
    )
    got = {r["snapshot_month"]: r["is_new_account"] for r in mart.collect()}
    assert got == {D(2023, 11, 1): 1, D(2023, 12, 1): 1, D(2024, 1, 1): 1, D(2024, 2, 1): 0}


def test_links_that_read_alike_are_counted_apart(spark):
    """Text ids: 'a' + 'b-c' and 'a-b' + 'c' are one combination as text, but two billing and
    two app accounts; so are an app account 'none' and no app account."""
    bills = spark.createDataFrame([("a", 1), ("a-b", 2), ("d", 3), ("d", 4)], "billing_account_id string, billing_account_bridge_id long")
    apps = [("b-c", 1, False), ("c", 2, False), ("none", 3, False)]
    apps = spark.createDataFrame(apps, "app_account_id string, billing_account_bridge_id long, is_internal_account boolean")
    src = SimpleNamespace(billing_accounts=bills, app_accounts=apps)
    assert profile.bridge_profile(src).first().asDict() == {
        "total_rows": 4,
        "unique_billing_accounts": 3,
        "unique_app_accounts": 3,
        "unique_combinations": 2,
    }
