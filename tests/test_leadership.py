"""The leadership summary's exact account counts against a brute force, on random mart rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerline.plans import reports

SCHEMA = (
    "billing_account_id {id}, customer_segment string, snapshot_month date, ending_arr double, arr_change double, "
    "active_users bigint, total_activity bigint, total_meetings bigint, lifecycle_segment string, is_expansion_ready int"
)
LAST = dt.date(2024, 8, 1)


def _periods(m: dt.date) -> list[str]:
    this_year, same_quarter = m.year == 2024, (m.month - 1) // 3
    out = []
    if m == LAST:
        out.append("this_month")
    if m == dt.date(2024, 7, 1):
        out.append("last_month")
    if this_year and same_quarter == 2 and m <= LAST:
        out.append("this_quarter")
    if this_year and m.month in (4, 5):  # the quarter's first two months, as many as have passed
        out.append("last_quarter")
    if this_year and m <= LAST:
        out.append("this_year")
    if m.year == 2023 and m.month <= 8:
        out.append("last_year")
    return out


def _brute(rows):
    accounts, sums = {}, {}
    for a, seg, month, arr, change, users, activity, meetings, life, ready in rows:
        for p in _periods(month):
            for key in ((p, False, seg), (p, True, "overall")):
                flags = accounts.setdefault(key, {}).setdefault(a, [0, 0, 0, 0])
                for k, on in enumerate((life == "healthy", life == "at_risk", life == "under_adopted", ready == 1)):
                    flags[k] |= on
                s = sums.setdefault(key, [0, 0, 0, 0, 0, 0])
                for k, v in enumerate((arr, change, users, activity, meetings, 1)):
                    s[k] += v
    out = []
    for (p, _, seg), by_account in accounts.items():
        s = sums[(p, _, seg)]
        avg = int(s[2] / s[5] * 100 + 0.5) / 100
        counts = [sum(f[k] for f in by_account.values()) for k in range(4)]
        out.append((p, seg, len(by_account), s[0], s[1], avg, s[3], s[4], *counts))
    return out


@pytest.mark.parametrize("id_type", ["bigint", "string"])
@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_a_brute_force(spark, id_type, seed):
    """Accounts in several segments, a segment that is NULL or called 'overall', a hot account, app rows."""
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        n = 0 if rng.random() < 0.33 else rng.randrange(1, 40)
        month = dt.date(rng.choice((2022, 2023, 2024)), rng.randrange(1, 9), 1)
        rows.append(
            (
                n if id_type == "bigint" else f"acc-{n}",
                rng.choice(("Small", "Large", None, "overall")),
                month,
                float(rng.randrange(1000)),
                float(rng.randrange(-50, 50)),
                rng.randrange(9),
                rng.randrange(100),
                rng.randrange(30),
                rng.choice(("healthy", "at_risk", "under_adopted", "new")),
                rng.randrange(2),
            )
        )
    rows.append((rows[0][0], "Small", LAST, 1.0, 0.0, 1, 1, 1, "new", 0))
    mart = spark.createDataFrame(rows, SCHEMA.format(id=f"{id_type}")).repartition(7)
    got = [tuple(r) for r in reports.leadership_summary(mart).collect()]
    assert sorted(got, key=repr) == sorted(_brute(rows), key=repr)


def test_empty_mart_has_no_rows(spark):
    assert reports.leadership_summary(spark.createDataFrame([], SCHEMA.format(id="string"))).count() == 0


def test_one_narrow_row_per_account_is_shuffled(spark):
    """One pass and two exchanges: accounts, then the few sums of period and segment."""
    mart = spark.createDataFrame([], SCHEMA.format(id="string"))
    plan = reports.leadership_summary(mart)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "collect_list" not in plan and "Window" not in plan
