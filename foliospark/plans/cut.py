"""Cuts through an ordered table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets into which a range of values is split at a time; their sums are all that comes to the driver.
BUCKETS = 1024


def weight_cut(df: DataFrame, order: str, weight: str, budget: int) -> tuple[int | None, int]:
    """(value, weight above it): the greatest whole-number ``order`` value at which the rows from it upward first
    exceed ``budget``; None when all rows fit. Each round sums BUCKETS ranges and looks into the one that crosses."""
    first = df.agg(F.min(order), F.max(order), F.coalesce(F.sum(weight), F.lit(0))).first()
    low, high, total = first[0], first[1], first[2]
    if low is None or total <= budget:
        return None, total
    above = 0
    while True:
        width = max(1, -(-(high - low + 1) // BUCKETS))
        sums = df.where(F.col(order).between(low, high)).groupBy(F.floor((F.col(order) - F.lit(low)) / F.lit(width)).alias("bucket")).agg(F.sum(weight).alias("w")).collect()  # BUCKETS rows at most
        for row in sorted(sums, key=lambda r: -r["bucket"]):
            if above + row["w"] > budget:
                break
            above += row["w"]
        start = low + row["bucket"] * width
        if width == 1:
            return start, above
        low, high = start, min(high, start + width - 1)


def keep_newest(df: DataFrame, budget: int, weight: str, order: str, tie: str) -> DataFrame:
    """The rows of the greatest (order, tie) whose weights together fit into ``budget``: rows are taken from the top
    until one does not fit, and none below it is kept. ``order`` and ``tie`` are whole numbers without nulls."""
    at, above = weight_cut(df, order, weight, budget)
    if at is None:
        return df
    same = df.where(F.col(order) == at)
    inner, _ = weight_cut(same, tie, weight, budget - above)
    kept = df.where(F.col(order) > at)
    return kept.unionByName(same) if inner is None else kept.unionByName(same.where(F.col(tie) > inner))
