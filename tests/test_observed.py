"""Checks counted while the mart is built: repeated days, NULL keys, label domains."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.plans import observed
from ledgerline.plans.mart import build_models, lifecycle_mart
from ledgerline.publish import published_run
from tests.conftest import D, app, arr_row, billing, make_sources, usage_row, user

AS_OF = D(2024, 4, 1)
CLEAN = {
    "repeated_usage_days": 0,
    "repeated_arr_days": 0,
    "null_mart_keys": 0,
    "unknown_lifecycle_segment": 0,
    "unknown_reason_code": 0,
    "unknown_recommended_action": 0,
    "unknown_is_expansion_ready": 0,
}


def sources(spark, more_arr=(), more_usage=()):
    """Days 1 and 31 of a month, and the same day of two months, are no repeats."""
    return make_sources(
        spark,
        billing=[billing(n, bridge=n) for n in (1, 2)],
        apps=[app(n, n) for n in (1, 2)],
        users=[user(10, 1), user(20, 2)],
        usage=[usage_row(D(2024, m, d), u, meeting_count=1) for m in (1, 3) for d in (1, 31) for u in (10, 20)] + list(more_usage),
        arr=[arr_row(D(2024, m, d), b, 100, 100) for m in (1, 3) for d in (1, 31) for b in (1, 2)] + list(more_arr),
    )


# account 1's 31st twice more (one repeats the values, one has others), and a user of no bridged app
REPEATS = {
    "more_arr": [arr_row(D(2024, 1, 31), 1, 100, 100), arr_row(D(2024, 1, 31), 1, 100, 50)],
    "more_usage": [usage_row(D(2024, 3, 1), 10), usage_row(D(2024, 2, 2), 99), usage_row(D(2024, 2, 2), 99)],
}


def built(src, path):
    checks = observed.RunChecks()
    mart = checks.mart(lifecycle_mart(build_models(src, checks=checks), AS_OF))
    mart.write.parquet(str(path))
    return checks


def test_clean_sources_count_zero(spark, tmp_path):
    checks = built(sources(spark), tmp_path / "mart")
    assert checks.found() == CLEAN == checks.require()


def test_repeated_days_are_counted_in_the_pass(spark, tmp_path):
    checks = built(sources(spark, **REPEATS), tmp_path / "mart")
    # no query of their own: what the write reported is enough
    checks._watched = [(seen, None) for seen, _ in checks._watched]
    assert checks.found() == CLEAN | {"repeated_arr_days": 2, "repeated_usage_days": 2}
    with pytest.raises(observed.CheckFailed, match="repeated_arr_days: 2, repeated_usage_days: 2"):
        checks.require()


def test_what_the_write_did_not_report_is_counted(spark, tmp_path, monkeypatch):
    """A part that Spark left out of the plan reports nothing."""
    checks = observed.RunChecks()
    build_models(sources(spark, **REPEATS), checks=checks)  # watched, and nothing run
    monkeypatch.setattr(observed, "REPORT_SECONDS", 0.1)
    assert checks.found() == {"repeated_arr_days": 2, "repeated_usage_days": 2}


def test_watched_mart_equals_the_plain_one(spark):
    src, checks = sources(spark, **{"more_usage": REPEATS["more_usage"]}), observed.RunChecks()
    a = checks.mart(lifecycle_mart(build_models(src, checks=checks), AS_OF))
    b = lifecycle_mart(build_models(src), AS_OF)
    assert a.schema == b.schema and sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_labels_and_keys_outside_their_domain(spark):
    mart = lifecycle_mart(build_models(sources(spark)), AS_OF)
    rows = mart.count()
    bad = mart.withColumns({"reason_code": F.lit("other"), "lifecycle_segment": F.lit(None).cast("string"), "billing_account_id": F.lit(None).cast("bigint")})
    checks = observed.RunChecks()
    checks.mart(bad).write.format("noop").mode("overwrite").save()
    found = checks.found()
    assert (found["unknown_reason_code"], found["unknown_lifecycle_segment"], found["null_mart_keys"]) == (rows,) * 3
    assert found["unknown_recommended_action"] == found["unknown_is_expansion_ready"] == 0


@pytest.mark.parametrize("with_state", [False, True])
def test_a_strict_run_stops_and_publishes_nothing(spark, tmp_path, with_state):
    from ledgerline.__main__ import main

    tables, out = tmp_path / "tables", str(tmp_path / "out")
    src = sources(spark)
    for name in ("billing_accounts", "app_accounts", "app_users", "app_usage_daily", "arr_daily"):
        getattr(src, name).coalesce(1).write.parquet(str(tables / name))
    args = ["--parquet", str(tables), "--as-of", "2024-04-01", "--out", out, "--id-type", "bigint"]
    args += ["--state", str(tmp_path / "state")] if with_state else []
    assert main([*args, "--strict"]) == 0
    first = published_run(spark, out)
    repeated = sources(spark, **REPEATS).arr_daily.where("date = '2024-01-31'").coalesce(1)
    repeated.write.mode("append").parquet(str(tables / "arr_daily"))
    for _ in range(2):  # the state did not move on, so it is found again
        with pytest.raises(observed.CheckFailed, match="repeated_arr_days: 4"):
            main([*args, "--strict"])
        assert published_run(spark, out) == first
    assert main(args) == 0  # reported, not stopped
    now = published_run(spark, out)
    listed = spark.read.option("header", True).csv(f"{now}/checks/run_checks").collect()
    assert now != first and [tuple(r) for r in listed] == [("repeated_arr_days", "4")]
