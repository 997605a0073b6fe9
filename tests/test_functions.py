"""Column helpers against the SQL engine's own functions on many random values."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from ledgerline.functions.dates import months_between_starts, months_into_period
from ledgerline.functions.numeric import round_half_away


def test_round_half_away_matches_sql_round(spark):
    rng = random.Random(5)
    values = [round(rng.uniform(-50, 50), 3) for _ in range(1500)]  # many exact .xx5 texts
    values += [rng.uniform(0, 1) for _ in range(1000)] + [k / 1000 for k in range(-2000, 2001, 5)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select(
        round_half_away(F.col("x"), 2).alias("r2"), round_half_away(F.col("x"), 1).alias("r1")
    ).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t(i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = con.execute("SELECT round(x, 2), round(x, 1) FROM t ORDER BY i").fetchall()
    assert [(r["r2"], r["r1"]) for r in got] == want


def test_month_boundaries_match_sql_date_diff(spark):
    rng = random.Random(9)
    start = dt.date(1998, 1, 1)
    pairs = [
        (start + dt.timedelta(days=rng.randrange(2000)), start + dt.timedelta(days=rng.randrange(2000)))
        for _ in range(1500)
    ]
    df = spark.createDataFrame(pairs, "a date, b date")
    got = df.select(
        months_between_starts(F.col("a"), F.col("b")).alias("d"),
        months_into_period(F.col("b"), "QUARTER").alias("q"),
        months_into_period(F.col("b"), "YEAR").alias("y"),
    ).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE p(i INTEGER, a DATE, b DATE)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", [(i, a, b) for i, (a, b) in enumerate(pairs)])
    want = con.execute(
        "SELECT date_diff('month', a, b), date_diff('month', date_trunc('quarter', b), b),"
        " date_diff('month', date_trunc('year', b), b) FROM p ORDER BY i"
    ).fetchall()
    assert [(r["d"], r["q"], r["y"]) for r in got] == want
