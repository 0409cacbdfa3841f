"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def unroll(df: DataFrame, keep: list, array: Column, position: str, value: str) -> DataFrame:
    """One row per array element with its position, from 0.

    A plain explode makes the optimizer add a filter on the array's size, for which it
    computes the array once more. With the outer form the array is computed once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value))
    return rows.filter(F.col(position).isNotNull())
