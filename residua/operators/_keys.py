"""Keyed joins that keep null keys, hot keys and partitioning in line.

Group keys are packed into one struct column ``__gk``.  A struct is never
null and its null fields compare equal, so a plain equi-join on it is
null-safe; and because aggregates, joins and windows all use the same
column, a shuffle done for one of them satisfies the next (no second
exchange of the big side, which a ``coalesce/isnull`` rewrite of a
null-safe join would cause).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP_KEY = "__gk"


def group_key(keys: list[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys])


def with_group_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add (or rebuild) ``__gk`` from ``keys``."""
    return df.withColumn(GROUP_KEY, group_key(keys))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join of ``right``'s extra columns onto ``left``.

    Both sides carry the ``keys`` columns; the join is a plain equi-join
    on ``__gk`` built from them (and dropped after): AQE broadcasts
    ``right`` when its runtime size is small and splits skewed partitions
    of ``left`` otherwise.
    """
    if not keys:
        raise ValueError("join_on_keys needs at least one key")
    r = with_group_key(right, keys).drop(*keys)
    return with_group_key(left, keys).join(r, GROUP_KEY, how).drop(GROUP_KEY)
