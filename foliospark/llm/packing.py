"""Filling containers of fixed capacity with texts, by planning over the histogram of lengths.

The plan is best-fit over counts: lengths are taken from long to short, and all items of one length go at once into
the open containers with the least sufficient space, which are kept as ranges of equal containers. Its size depends on
the capacity, never on the number of texts. Each item then takes the slot of its rank within its length.

Defined cases: a text longer than the capacity is divided into full pieces and one remainder, no other text is divided;
null and empty texts measure 0 and are spread over the containers; ties in length are ordered by id; every row gets its
slots, repeated ids too; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise
from ..sources.tables import table
from .tokens import token_counts

#: Items of one length that are ranked by one task; a length with more is split into parts.
RANKED = 100_000


@dataclass(frozen=True)
class Run:
    """Items of ``length`` with ranks from ``rank`` on, ``per`` of them in each container from ``container`` on."""

    length: int
    rank: int
    per: int
    container: int


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit decreasing over counts: the runs, and the number of containers."""
    runs: list[Run] = []
    spaces: list[int] = []
    open_at: dict[int, list[tuple[int, int]]] = {}
    used = 0

    def leave(space: int, first: int, count: int) -> None:
        if count <= 0 or space <= 0:
            return
        if space not in open_at:
            insort(spaces, space)
            open_at[space] = []
        open_at[space].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, total = 0, histogram[length]
        while rank < total:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count = open_at[space].pop()
                if not open_at[space]:
                    del open_at[space]
                    spaces.pop(at)
            else:
                space, first, count = capacity, used, -(-(total - rank) // (capacity // length))
                used += count
            per, left = space // length, total - rank
            full, odd = divmod(min(left, per * count), per)
            runs.append(Run(length, rank, per, first))
            rank += full * per + odd
            leave(space - per * length, first, full)
            if odd:
                leave(space - odd * length, first + full, 1)
            leave(space, first + full + bool(odd), count - full - bool(odd))
    return runs, used


def pieces(counts: DataFrame, capacities: dict[str, int]) -> DataFrame:
    """(target_name, capacity, id, piece_no, token_start, n_tokens): each text whole, or its full pieces and remainder."""
    each = F.array(*[F.struct(F.lit(name).alias("target_name"), F.lit(capacity).cast("long").alias("capacity")) for name, capacity in capacities.items()])
    wide = counts.select("item_id", "n_tokens", F.inline(each))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr("(n_tokens - 1) div capacity")))
    cut = wide.select("target_name", "capacity", "item_id", "n_tokens", F.explode(parts).alias("piece"))
    start = F.col("piece") * F.col("capacity")
    return cut.select(
        "target_name", "item_id", F.col("piece").cast("int").alias("piece_no"), start.alias("token_start"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("n_tokens")
    )


def ranked(items: DataFrame, most: int) -> DataFrame:
    """Adds rank: 0, 1, ... within (target_name, n_tokens). A length, of which there are ``most`` items at most, is ranked
    in parts of about RANKED items, whose counts give each part its first rank."""
    part = ["target_name", "n_tokens", "salt"]
    salted = items.withColumn("salt", F.pmod(F.xxhash64("item_id", "piece_no"), F.lit(max(1, -(-most // RANKED)))))
    firsts = salted.groupBy(*part).agg(F.count("*").alias("size")).withColumn(
        "first", F.sum("size").over(Window.partitionBy("target_name", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ).select(*part, F.coalesce("first", F.lit(0)).alias("first"))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy(*part).orderBy("item_id", "piece_no")))
    return local.join(firsts.hint("merge"), part).withColumn("rank", F.col("first") + F.col("local") - 1).drop("salt", "local", "first")


def pack(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """(item_id, n_tokens) and (target_name, capacity_tokens) to (target_name, item_id, piece_no, token_start,
    n_tokens, container_id)."""
    wanted = targets.where("target_name is not null and capacity_tokens > 0").dropDuplicates(["target_name"])
    capacities = {r["target_name"]: r["capacity_tokens"] for r in wanted.select("target_name", "capacity_tokens").collect()}
    kind = counts.schema["item_id"].dataType.simpleString()
    result = f"target_name string, item_id {kind}, piece_no int, token_start long, n_tokens long, container_id long"
    if not capacities:
        return counts.sparkSession.createDataFrame([], result)
    items = pieces(counts, capacities)
    histograms: dict[str, dict[int, int]] = {name: {} for name in capacities}
    # at most one row for each length up to each capacity
    for row in items.groupBy("target_name", "n_tokens").agg(F.count("*").alias("items")).toLocalIterator():
        histograms[row["target_name"]][row["n_tokens"]] = row["items"]
    plans = {}
    for name, capacity in capacities.items():
        runs, used = plan_containers(histograms[name], capacity)
        runs.sort(key=lambda r: (r.length, r.rank))
        plans[name] = tuple(np.array([getattr(r, k) for r in runs], np.int64) for k in ("length", "rank", "per", "container")) + (max(used, 1),)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["container_id"] = np.int64(0)
            for name, rows in batch.groupby("target_name").indices.items():
                length, rank, per, container, used = plans[name]
                own, place = batch["n_tokens"].to_numpy()[rows], batch["rank"].to_numpy()[rows]
                slot = place % used
                sized = own > 0
                if sized.any():
                    starts = np.searchsorted(length, own[sized])
                    ends = np.searchsorted(length, own[sized], side="right")
                    # ranks within a length ascend: one search over (length, rank) as a single ordered key
                    widest = max(int(rank.max()), int(place[sized].max())) + 1
                    found = np.searchsorted(length * widest + rank, own[sized] * widest + place[sized], side="right") - 1
                    found = np.clip(found, starts, ends - 1)
                    slot[sized] = container[found] + (place[sized] - rank[found]) // per[found]
                batch.loc[batch.index[rows], "container_id"] = slot
            yield batch[["target_name", "item_id", "piece_no", "token_start", "n_tokens", "container_id"]]

    return ranked(items, max((n for h in histograms.values() for n in h.values()), default=0)).mapInPandas(take, result)


def p9_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every text, or piece of one, for each target."""
    counts = materialise(token_counts(table(spark, folder, "documents")).withColumnRenamed("doc_id", "item_id"), "token-counts")
    return pack(counts, table(spark, folder, "pack_targets")).withColumnRenamed("item_id", "doc_id")


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """For each target: texts divided, containers used, the least number possible by sum, and the share filled."""
    placed = p9_assignments(spark, folder)
    targets = table(spark, folder, "pack_targets").select("target_name", F.col("capacity_tokens").cast("long").alias("capacity"))
    sums = placed.groupBy("target_name").agg(
        F.sum("n_tokens").alias("n_tokens"), (F.max("container_id") + 1).alias("containers"), F.sum(F.when(F.col("piece_no") == 1, 1).otherwise(0)).alias("divided_texts")
    ).join(targets, "target_name")
    return sums.select(
        "target_name", "capacity", "n_tokens", "containers", "divided_texts",
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_containers"), F.round(F.col("n_tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"),
    )
