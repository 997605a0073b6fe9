"""Join helpers for the two shapes that hurt at scale: NULL keys and small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_null_keys_apart(left: DataFrame, right: DataFrame, key: str, right_cols: list[str]) -> DataFrame:
    """``left LEFT JOIN right ON left.key = right.key`` where many left keys may be NULL.

    A NULL key never matches, but a shuffle join still hashes every NULL-key row to
    one partition; when a large share of rows has no key that partition becomes the
    straggler. Rows without a key skip the join and get NULL right-side columns.
    """
    r = right.select(F.col(key), *[F.col(c) for c in right_cols])
    keyed = left.where(F.col(key).isNotNull()).join(r, on=key, how="left")
    unkeyed = left.where(F.col(key).isNull())
    for c in right_cols:
        unkeyed = unkeyed.withColumn(c, F.lit(None).cast(r.schema[c].dataType))
    return keyed.unionByName(unkeyed)
