"""Ranks within groups of which one may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Least parts into which the rows are split by ranges of group and order.
PARTS = 64


def ranked_within(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``rank``: 0, 1, ... within ``group`` by ``order`` (which must tell the rows of a group apart; nulls come
    first). Rows are split by ranges of (group, order), whose borders come from a sample of every input part, so a hot
    group lies in many parts; each part is ranked by itself, and the parts' counts give their first ranks. The parts are
    written once, so that both uses see the same borders."""
    parts = max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = materialise(df.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parted.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return local.join(firsts.hint("merge"), same).withColumn("rank", F.col("_first") + F.col("_local") - 1).select(*df.columns, "rank")
