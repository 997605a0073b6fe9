"""The exported profiling listings: complete, and in the order of their listing."""

from __future__ import annotations

import csv
import glob

import pytest

from ledgerline import catalog
from ledgerline.plans import profile, sinks
from ledgerline.plans.mart import build_models
from tests.conftest import D, app, arr_row, billing, make_sources, usage_row, user


@pytest.fixture(scope="module")
def exported(spark, tmp_path_factory):
    """Ties in every count, an account with three apps, NULL groups."""
    accounts = [billing(n, bridge=n % 5 or None, segment=("Small", "Large", None)[n % 3], name=f"N{n % 4}") for n in range(1, 25)]
    src = make_sources(
        spark,
        billing=accounts,
        apps=[app(n, n % 5 or None, signup=D(2024, n % 3 + 1, 1), internal=n == 7) for n in range(1, 13)],
        users=[user(100 + n, n % 12 + 1, tiers=f'["t{n % 6}"]') for n in range(40)],
        usage=[usage_row(D(2024, n % 4 + 1, n % 27 + 1), 100 + n % 30, meeting_count=n % 3, note_synced_count=n % 2) for n in range(80)],
        arr=[arr_row(D(2024, m, 1), n, 100, 100 * ((n + m) % 3)) for n in range(1, 25) for m in (1, 2, 3)],
    )
    models = build_models(src)
    out = str(tmp_path_factory.mktemp("profiles"))
    paths = sinks.export_profiles(src, models.arr_monthly, out)

    def rows(name):
        files = sorted(glob.glob(f"{paths[name]}/part-*.csv"))  # part numbers follow the order
        return [r for f in files for r in csv.DictReader(open(f))]

    return src, models, rows


def _counts(rows, column):
    return [int(r[column]) for r in rows]


def test_every_profile_query_is_exported_whole(exported):
    src, models, rows = exported
    assert set(sinks.PROFILE_ORDER) <= set(catalog.QUERIES)
    for name in sinks.PROFILE_ORDER:
        query = getattr(profile, name)
        df = query(models.arr_monthly) if name.startswith("arr_movement") else query(src)
        assert len(rows(name)) == df.count() > 0, name


@pytest.mark.parametrize(
    ("name", "count", "ties"),
    [
        ("names_per_bridge", "billing_account_names", "billing_account_bridge_id"),
        ("multi_app_accounts", "app_account_count", "billing_account_id"),
        ("segment_counts", "count", "customer_segment"),
        ("arr_movement_counts", "account_months", "arr_movement_type"),
        ("utilisation_buckets", "account_months", "active_user_bucket"),
        ("seat_tier_top10", "count", "seat_tiers_array"),
    ],
)
def test_counts_descend_and_ties_follow_the_keys(exported, name, count, ties):
    _, _, rows = exported
    listing = rows(name)
    assert _counts(listing, count) == sorted(_counts(listing, count), reverse=True) and len(listing) > 1
    numeric = all(r[ties].isdigit() for r in listing if r[ties])
    # an empty field is NULL, which comes last among equal counts
    keys = [(-int(r[count]), r[ties] == "", int(r[ties]) if numeric and r[ties] else r[ties]) for r in listing]
    assert keys == sorted(keys)


def test_dated_listings_ascend(exported):
    _, _, rows = exported
    for name, column in (("arr_movement_by_month", "snapshot_month"), ("zero_usage_by_signup_month", "signup_month"), ("zero_usage_app_accounts", "signup_date")):
        dates = [r[column] for r in rows(name)]
        assert dates == sorted(dates) and dates, name
