"""Monthly state kept between runs, and runs published as a whole."""

from __future__ import annotations

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline import catalog, publish
from ledgerline.plans import sinks, state
from ledgerline.plans.mart import build_models, lifecycle_mart
from ledgerline.sources import read_parquet_sources

SF = "/root/testdata/sf0.001"
D = dt.date
FEEDS = {"arr_daily": "billing_account_id", "app_usage_daily": "app_user_id"}
ACCOUNTS = ("billing_accounts", "app_accounts", "app_users")


@pytest.fixture
def tables(spark, tmp_path):
    """The five tables as parquet; each feed in a file per quarter, the last half year left out."""
    src, out = catalog.Context(spark, SF).src, tmp_path / "tables"
    for name in ACCOUNTS:
        getattr(src, name).write.parquet(str(out / name))
    for name in FEEDS:
        early = getattr(src, name).where("date < DATE '2001-02-01'")
        early.repartition(6, F.quarter("date"), F.year("date")).write.parquet(str(out / name))
    return out


def full(spark, tables):
    return lifecycle_mart(build_models(read_parquet_sources(spark, str(tables), T.LongType())), "2001-08-01")


def from_state(spark, tables, root):
    kept = state.refresh(spark, str(tables), str(root), T.LongType())
    models = build_models(read_parquet_sources(spark, str(tables), T.LongType()), kept.user_month, kept.arr_monthly)
    return lifecycle_mart(models, "2001-08-01"), kept.rebuilt


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def runs(root, name):
    return sorted(d for d in os.listdir(root / name) if d.startswith("run="))


def test_an_added_day_rebuilds_its_month_alone(spark, tables, tmp_path):
    root = tmp_path / "state"
    mart, rebuilt = from_state(spark, tables, root)
    same(mart, full(spark, tables))
    assert len(rebuilt["arr_monthly"]) > 12

    src = catalog.Context(spark, SF).src
    for name, key in FEEDS.items():
        rows = getattr(src, name)
        late = rows.where("date >= DATE '2001-02-01'").dropDuplicates([key])
        new = late.join(rows.where("date = DATE '2000-11-30'"), key, "left_anti").withColumn("date", F.lit(D(2000, 11, 30)))
        new.select(*rows.columns).coalesce(1).write.mode("append").parquet(str(tables / name))
    mart, rebuilt = from_state(spark, tables, root)
    assert rebuilt["arr_monthly"] == [D(2000, 11, 1)]
    assert rebuilt["user_month"] == [D(2000, 11, 1)]
    for name in rebuilt:
        written = runs(root, name)
        assert len(written) == 2
        months = [sorted(d for d in os.listdir(root / name / r) if d.startswith("snapshot")) for r in written]
        assert ["snapshot_month=2000-11-01"] in months
    same(mart, full(spark, tables))

    mart, rebuilt = from_state(spark, tables, root)
    assert not any(rebuilt.values())
    same(mart, full(spark, tables))


def test_a_file_that_goes_and_one_that_changes(spark, tables, tmp_path):
    root = tmp_path / "state"
    state.refresh(spark, str(tables), str(root), T.LongType())
    files = sorted((tables / "arr_daily").glob("part-*.parquet"), key=lambda f: f.stat().st_size)
    months = {r[0] for r in spark.read.parquet(str(files[-1])).select(F.trunc("date", "MM")).distinct().collect()}
    files[-1].unlink()
    mart, rebuilt = from_state(spark, tables, root)
    assert set(rebuilt["arr_monthly"]) == months and rebuilt["user_month"] == []
    same(mart, full(spark, tables))

    # a file of the same name with other rows
    other = tmp_path / "other"
    spark.read.parquet(str(files[0])).withColumn("ending_arr", F.col("ending_arr") + 7).coalesce(1).write.parquet(str(other))
    (tables / "arr_daily" / f".{files[0].name}.crc").unlink(missing_ok=True)
    shutil.copy(next(other.glob("part-*.parquet")), files[0])
    mart, rebuilt = from_state(spark, tables, root)
    assert rebuilt["arr_monthly"]
    same(mart, full(spark, tables))
    before = len(runs(root, "arr_monthly"))
    gone = state.vacuum(spark, str(root))
    assert len(runs(root, "arr_monthly")) + len([g for g in gone if "arr_monthly" in g]) == before
    same(from_state(spark, tables, root)[0], full(spark, tables))


def test_a_refresh_that_fails_changes_nothing(spark, tables, tmp_path, monkeypatch):
    root = tmp_path / "state"
    state.refresh(spark, str(tables), str(root), T.LongType())
    before = publish.latest(spark, f"{root}/manifest").orderBy("aggregate", "path", "month").collect()
    src = catalog.Context(spark, SF).src
    src.arr_daily.where("date >= DATE '2001-02-01'").write.mode("append").parquet(str(tables / "arr_daily"))

    def fail(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(publish, "commit", fail)
        with pytest.raises(OSError):
            state.refresh(spark, str(tables), str(root), T.LongType())
    assert publish.latest(spark, f"{root}/manifest").orderBy("aggregate", "path", "month").collect() == before
    mart, rebuilt = from_state(spark, tables, root)
    assert min(rebuilt["arr_monthly"]) == D(2001, 2, 1)
    same(mart, full(spark, tables))


def test_empty_feeds(spark, tables, tmp_path):
    src = catalog.Context(spark, SF).src
    empty = tmp_path / "empty"
    for name in FEEDS:
        getattr(src, name).limit(0).write.parquet(str(empty / name))
    kept = state.refresh(spark, str(empty), str(tmp_path / "state"), T.LongType())
    assert kept.user_month.isEmpty() and kept.arr_monthly.isEmpty()


def test_a_run_that_fails_leaves_the_old_one_published(spark, tables, tmp_path, monkeypatch):
    from ledgerline.__main__ import main

    out = tmp_path / "out"
    args = ["--parquet", str(tables), "--as-of", "2001-08-01", "--out", str(out), "--id-type", "bigint", "--state", str(tmp_path / "state")]
    assert main(args) == 0
    first = publish.published_run(spark, str(out))
    rows = spark.read.parquet(f"{first}/mart").count()
    same(spark.read.parquet(f"{first}/mart").select(*full(spark, tables).columns), full(spark, tables))

    src = catalog.Context(spark, SF).src
    src.arr_daily.where("date >= DATE '2001-02-01'").write.mode("append").parquet(str(tables / "arr_daily"))
    write = sinks.write_csv_report

    def fail_late(df, path, *rest, **kw):
        if path.endswith("retention_analysis"):
            raise OSError("lost")
        write(df, path, *rest, **kw)

    with monkeypatch.context() as m:
        m.setattr(sinks, "write_csv_report", fail_late)
        with pytest.raises(OSError):
            main(args)
    assert publish.published_run(spark, str(out)) == first
    assert spark.read.parquet(f"{first}/mart").count() == rows

    assert main(args) == 0
    last = publish.published_run(spark, str(out))
    assert last != first and spark.read.parquet(f"{last}/mart").count() > rows
    assert len(publish.remove_old_runs(spark, str(out))) == 2
    assert publish.published_run(spark, str(out)) == last and spark.read.parquet(f"{last}/mart").count() > rows


def test_an_incomplete_version_is_not_read(spark, tmp_path):
    base = str(tmp_path / "versions")
    assert publish.latest(spark, base) is None
    publish.commit(spark.range(1), base)
    os.makedirs(f"{base}/v000000002/_temporary")
    assert publish.latest(spark, base).count() == 1
    publish.commit(spark.range(3), base)
    assert publish.latest(spark, base).count() == 3
