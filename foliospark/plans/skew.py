"""Joins to a dictionary of distinct values when a few values may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A value is hot when it holds more than this share of the rows; so there are at most 1 / HOT_SHARE hot values.
HOT_SHARE = 0.005


def lookup(rows: DataFrame, dictionary: DataFrame, key: str, total: int, keep: Column, share: float = HOT_SHARE) -> DataFrame:
    """Inner join of ``rows`` to ``dictionary`` (unique ``key``, with ``n``, the rows that have the value).

    Hot values go through a broadcast of at most 1 / share dictionary rows, all others through a shuffled join, in
    which no key holds more than ``share`` of the rows. ``keep`` says which dictionary rows have a result."""
    limit = max(1.0, total * share)
    mark = dictionary.where(keep)
    hot, rest = mark.where(F.col("n") > limit).drop("n"), mark.where(F.col("n") <= limit).drop("n")
    hot_keys = dictionary.where(F.col("n") > limit).select(key)
    cold_rows = rows.join(F.broadcast(hot_keys), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(cold_rows.join(rest, key))
