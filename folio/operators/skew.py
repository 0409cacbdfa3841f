"""Lookups against a table with unique keys when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HOT_KEYS = 20_000


def hot_keys(facts: DataFrame, on: list[str], limit: int = HOT_KEYS) -> DataFrame:
    """The most frequent keys. What is left over holds at most 1/limit of the rows each."""
    return facts.groupBy(*on).count().orderBy(F.desc("count"), *on).limit(limit).select(*on)


def lookup(
    facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None
) -> DataFrame:
    """Join ``facts`` to ``dim``, whose keys are unique.

    Rows with one of the ``HOT_KEYS`` most frequent keys are joined by broadcasting
    just those keys' rows of ``dim`` (at most ``HOT_KEYS`` rows) and never shuffled.
    All other keys are rare by construction and are joined by shuffling.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    hot = hot_keys(facts, on) if hot is None else hot
    hot_dim = dim.join(F.broadcast(hot), on, "left_semi")
    some = facts if how == "inner" else facts.join(F.broadcast(hot), on, "left_semi")
    frequent = some.join(F.broadcast(hot_dim), on, how)
    rare = facts.join(F.broadcast(hot), on, "left_anti").join(dim, on, how)
    return frequent.unionByName(rare)
