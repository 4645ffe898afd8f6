"""Joins that survive hot keys.

A hot key is one of the ``most`` keys with the most rows.  ``most`` is a constant, so the list of hot keys and
the rows of a side that is unique by the key have a proven size and may be broadcast; every other key has at
most ``rows / most`` rows and is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HOT = 1000
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, rows: str | None = None, most: int = MOST_HOT, at_least: int = HOT_ROWS) -> DataFrame:
    """At most ``most`` keys that have ``at_least`` rows; ``rows`` names a column that already counts rows."""
    size = F.sum(rows) if rows else F.count(F.lit(1))
    return hot_list(df.where(F.col(key).isNotNull()).groupBy(key).agg(size.alias("_hot_rows")), key, "_hot_rows", most, at_least)


def hot_list(counted: DataFrame, key: str, rows: str, most: int = MOST_HOT, at_least: int = HOT_ROWS) -> DataFrame:
    """The hot keys of a table that has one row a key and its number of rows."""
    return counted.where(F.col(key).isNotNull() & (F.col(rows) >= at_least)).orderBy(F.desc(rows), key).limit(most).select(key)


def skew_join(left: DataFrame, unique: DataFrame, key: str, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """Join ``left`` with ``unique``, which has at most one row a key; ``how``: inner, left, left_semi or left_anti.

    Rows of hot keys meet a broadcast of at most ``MOST_HOT`` rows and are not shuffled; the rest is shuffled.
    A null key meets nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    hot = hot_keys(left, key) if hot is None else hot
    hot = F.broadcast(hot)
    hot_left, rest = left.join(hot, key, "left_semi"), left.join(hot, key, "left_anti")
    few = F.broadcast(unique.join(hot, key, "left_semi"))
    return hot_left.join(few, key, how).unionByName(rest.join(unique, key, how))
