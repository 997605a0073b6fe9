"""Written tables: reused by key, never half-read, partition values only on the table itself."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import functions as F

import ledgerline.session as S


def test_materialize_reuses_and_survives_an_incomplete_target(spark):
    df = spark.range(100).withColumn("m", (F.col("id") % 3).cast("string"))
    key = f"test-{uuid.uuid4().hex}"
    a = S.materialize(df, "probe", key, partition_by="m")
    assert a.count() == 100 and S.latest_partition(a, "m") == "2"
    assert S.latest_partition(a.where("m = '0'"), "m") is None  # a child does not inherit it
    S._WRITTEN.clear()
    assert S.materialize(df, "probe", key, partition_by="m").count() == 100  # found on disk

    other = f"test-{uuid.uuid4().hex}"
    digest = hashlib.sha1(f"{S.CODE_VERSION}|{other}".encode()).hexdigest()[:16]
    target = f"{S.checkpoint_dir(spark).rstrip('/')}/ledgerline/probe-{digest}"
    os.makedirs(target.removeprefix("file:"), exist_ok=True)  # an incomplete folder in the way
    c = S.materialize(df, "probe", other, partition_by="m")
    assert c.count() == 100
