"""What one task reads stays the same when the tables grow."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerline import catalog, session
from ledgerline.operators import signals
from ledgerline.plans import profile
from ledgerline.plans import mart

SIZES = (
    "spark.sql.files.maxPartitionBytes",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize",
)


@pytest.fixture
def sizes(spark):
    """Spark's own sizes of a task, put back as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in SIZES}
    for k in SIZES:
        spark.conf.unset(k)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _tables(spark, folder, orders: int) -> str:
    """``orders`` orders of half as many customers, each with four lines on days of their own."""
    n = F.col("id")
    spark.range(orders // 2).select(
        n.alias("c_custkey"), F.concat(F.lit("C"), n).alias("c_name"), F.lit("Small").alias("c_mktsegment")
    ).write.parquet(f"{folder}/customer.parquet")
    day = F.timestamp_seconds(F.lit(800_000_000) + n * 86_400 % 80_000_000)
    spark.range(orders).select(
        n.alias("o_orderkey"), F.floor(n / 2).alias("o_custkey"), day.alias("o_orderdate"), (n * 100.0).alias("o_totalprice")
    ).write.parquet(f"{folder}/orders.parquet")
    spark.range(orders * 4).select(
        F.floor(n / 4).alias("l_orderkey"),
        n.alias("l_partkey"),
        (n % 4 + 1).cast("int").alias("l_linenumber"),
        (n % 50).cast("double").alias("l_quantity"),
        day.alias("l_shipdate"),
    ).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_more_rows_give_more_tasks_and_not_larger_ones(spark, sizes, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    monkeypatch.setattr(session, "TASK_SHUFFLE_BYTES", 20_000)
    spark.conf.set(SIZES[3], "10k")  # Spark merges partitions of a small table up to 1 MB else
    c = catalog.Context(spark, _tables(spark, tmp_path / "t", 5000))
    per_file = c.src.app_usage_daily.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
    # 20,000 rows; in the session's four partitions a task had 5,000
    assert per_file[1] == 20_000
    assert per_file[0] < 2_500
    months = c.src.app_usage_daily.select("app_user_id", F.trunc("date", "MM")).distinct().count()
    assert c.models.usage_monthly.agg(F.sum("active_users")).first()[0] == months


def test_sizes_that_are_smaller_already_stay(spark, sizes):
    spark.conf.set(SIZES[0], "1m")
    spark.conf.set(SIZES[1], "64MB")
    session.bound_tasks(spark, 3 * session.TASK_ROWS + 1)
    assert spark.conf.get(SIZES[0]) == "1m"
    assert spark.conf.get(SIZES[1]) == str(session.TASK_SHUFFLE_BYTES)
    assert spark.conf.get(SIZES[2], None) is None  # the session has four partitions
    session.bound_tasks(spark, 9 * session.TASK_ROWS)
    session.bound_tasks(spark, 5 * session.TASK_ROWS)
    assert spark.conf.get(SIZES[2]) == "9"


@pytest.mark.parametrize("size, n", [("64MB", 64 << 20), ("8m", 8 << 20), ("67108864b", 64 << 20), ("5", 5), ("1g", 1 << 30)])
def test_sizes_are_read_as_spark_writes_them(size, n):
    assert session._bytes(size) == n


def test_mart_is_written_without_dealing_accounts_out_again(spark, sizes, tmp_path, monkeypatch):
    """Also in a session that has Spark's default for joins on more keys than the partitioning."""
    key, seen = "spark.sql.requireAllClusterKeysForCoPartition", []
    before = spark.conf.get(key)
    monkeypatch.setattr(mart, "materialize", lambda df, *a, **k: seen.append(spark.conf.get(key)) or df)
    spark.conf.set(key, "true")
    try:
        c = catalog.Context(spark, _tables(spark, tmp_path / "t", 40), dt.date(2001, 8, 1))
        assert c.mart.count() > 0
        assert spark.conf.get(key) == "true"
    finally:
        spark.conf.set(key, before)
    assert seen == ["false"]


@pytest.fixture
def unmerged(spark, sizes):
    """A session whose shuffles keep the four partitions that its submitter set."""
    keys = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(
    "query, groups",
    [
        ("int_usage_monthly", "app_account_id"),
        ("usage_by_billing_month", "billing_account_id"),
        ("adoption_by_billing_month", "billing_account_id"),
    ],
)
def test_more_rows_give_more_tasks_where_partitions_are_not_merged(spark, unmerged, tmp_path, monkeypatch, query, groups):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    out = catalog.queries()[query](spark, _tables(spark, tmp_path / "t", 5000))
    # 20,000 rows in at least 20 partitions; in the session's four a task had a quarter of the groups
    counts = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert out.select(groups).distinct().count() > 1000
    assert max(counts) < sum(counts) / 10


def test_partitions_of_a_session_without_adaptive_execution_grow_too(spark, unmerged):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        session.bound_tasks(spark, 9 * session.TASK_ROWS)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "9"
        session.bound_tasks(spark, 5 * session.TASK_ROWS)
        assert session.shuffle_partitions(spark) == 9
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert spark.conf.get(SIZES[2], None) is None


def test_account_months_are_in_more_tasks_where_partitions_are_not_merged(spark, unmerged, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 1000)
    months = profile._raw_account_months(catalog.Context(spark, _tables(spark, tmp_path / "t", 5000)).src)
    counts = [r["count"] for r in months.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) > 1000
    assert max(counts) < sum(counts) / 10


def test_slices_of_heavy_accounts_are_in_more_tasks(spark, sizes):
    months = spark.range(2000).select(F.col("id").alias("billing_account_id"), F.lit(1).alias("snapshot_month"))
    session.bound_tasks(spark, 16 * session.TASK_ROWS)
    dealt = signals._in_slices(months, {7: 40})
    counts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    # 2,039 rows in 16 partitions; in the session's four a task had 500
    assert sum(counts) == 2039
    assert max(counts) < 250
