"""Numeric helpers whose results must not depend on the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c: Column, digits: int) -> Column:
    """Round a DOUBLE the way ``round(x, d)`` does on binary doubles: scale, round, unscale.

    ``F.round(x, 2)`` rounds the shortest decimal text of ``x`` (1.005 -> 1.01),
    while scaling first rounds the binary value (1.005 * 100 = 100.4999... -> 1.00).
    """
    scale = float(10**digits)
    return F.round(c.cast("double") * F.lit(scale)) / F.lit(scale)


def exact_avg(c: Column, scale: int) -> Column:
    """Mean of values rounded to 1/scale: a sum of whole numbers and one division, so the
    order in which rows meet can't change it (a DOUBLE average depends on it)."""
    whole = F.round(c * F.lit(float(scale))).cast("decimal(38,0)")
    return F.sum(whole).cast("double") / (F.lit(float(scale)) * F.count(c))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator * 1.0 / nullif(denominator, 0)`` as DOUBLE; NULL instead of a divide-by-zero error."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))
