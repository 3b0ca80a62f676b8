"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unfold(df: DataFrame, keys, array, pos: str, value: str) -> DataFrame:
    """One row per element, with its position.

    Plain ``explode`` adds a filter on the array's size, which the optimizer moves below the
    projection that builds the array, so the array would be built once more for the filter.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())
