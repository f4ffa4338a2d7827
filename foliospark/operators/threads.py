"""Conversations as adjacency lists: parents by depth, reply trees, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise

#: Replies deeper than this are shown at this depth.
MOST_DEPTH = 12


def parents_by_depth(comments: DataFrame) -> DataFrame:
    """(thread_id, id, pos, depth, parent_id): the parent of a comment is the last one before it at the depth above,
    within the same branch; null at depth 0 and where a depth was skipped. A thread is one page's comments; it is folded
    in one row, with the ids of the open branch as state."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "depth", "id")))
    threads = comments.groupBy("thread_id").agg(ordered.alias("items"))

    def step(acc: Column, x: Column) -> Column:
        above = F.element_at(F.filter(acc["open"], lambda o: o["depth"] == x["depth"] - 1), -1)
        parent = F.when((x["depth"] > 0) & (F.size(F.filter(acc["open"], lambda o: o["depth"] == x["depth"] - 1)) > 0), above["id"])
        left = F.concat(F.filter(acc["open"], lambda o: o["depth"] < x["depth"]), F.array(F.struct(x["depth"].alias("depth"), x["id"].alias("id"))))
        return F.struct(left.alias("open"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), x["pos"].alias("pos"), x["depth"].alias("depth"), parent.alias("parent_id")))).alias("out"))

    ids, pos, depth = (comments.schema[c].dataType.simpleString() for c in ("id", "pos", "depth"))
    start = F.struct(F.array().cast(f"array<struct<depth:{depth},id:{ids}>>").alias("open"), F.array().cast(f"array<struct<id:{ids},pos:{pos},depth:{depth},parent_id:{ids}>>").alias("out"))
    return threads.select("thread_id", F.inline(F.aggregate("items", start, step, lambda acc: acc["out"])))


def top_level(items: DataFrame, root: str = "root_id") -> DataFrame:
    """Items whose parent is missing, the thread's root, or not among the thread's items."""
    known = items.select("thread_id", F.col("id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    joined = items.join(known, ["thread_id", "parent_id"], "left")
    return joined.where(F.col("parent_id").isNull() | (F.col("parent_id").cast("string") == "") | (F.col("parent_id") == F.col(root)) | F.col("_known").isNull()).drop("_known")


def reply_paths(items: DataFrame) -> DataFrame:
    """(thread_id, id, depth, path): each item's depth in the tree and the order in which a reader meets it, found by
    joining one level after the other until none is left."""
    base = items.select("thread_id", "id", "parent_id", F.lpad(F.col("pos").cast("string"), 20, "0").alias("step"))
    known = base.select("thread_id", F.col("id").alias("parent_id")).distinct().withColumn("_known", F.lit(True))
    level = materialise(base.join(known, ["thread_id", "parent_id"], "left").where("_known is null").select("thread_id", "id", F.lit(0).alias("depth"), F.col("step").alias("path")), "replies")
    found = level
    while not level.isEmpty():
        up = level.select("thread_id", F.col("id").alias("parent_id"), "depth", "path")
        level = materialise(base.join(up, ["thread_id", "parent_id"]).select("thread_id", "id", F.least(F.col("depth") + 1, F.lit(MOST_DEPTH)).alias("depth"), F.concat_ws("/", "path", "step").alias("path")), "replies")
        found = found.unionByName(level)
    return found


def quote_block(text: Column) -> Column:
    """Every line behind ``>``."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^", "> "), r"(?m)^> $", ">")


def align_results(results: DataFrame) -> DataFrame:
    """(batch_id, position, caption, cache_safe): results of a batch joined to their inputs by index when the indexes are
    all valid and distinct, else by place, which may be cached only when none is missing."""
    checked = results.groupBy("batch_id").agg(
        F.max("expected_count").alias("expected"), F.count("*").alias("n"), F.countDistinct("image_index").alias("distinct_n"), F.min("image_index").alias("low"), F.max("image_index").alias("high"),
        F.array_sort(F.collect_list(F.struct("pos", "image_index", "caption"))).alias("rows"),
    )
    valid = (F.col("distinct_n") == F.col("n")) & (F.col("low") >= 1) & (F.col("high") <= F.col("expected"))
    safe = valid | (F.col("n") == F.col("expected"))
    each = checked.select("batch_id", "expected", valid.alias("valid"), safe.alias("cache_safe"), F.posexplode("rows").alias("at", "x"))
    place = F.when(F.col("valid"), F.col("x.image_index") - 1).otherwise(F.col("at"))
    return each.select("batch_id", place.cast("int").alias("position"), F.col("x.caption").alias("caption"), "cache_safe", "expected").where("position < expected").drop("expected")


def leading_run(items: DataFrame) -> DataFrame:
    """Rows (thread_id, pos, author, ...) of a thread's first author before anyone else writes: the first item and its
    continuation. Where a thread has no other author all its rows stay; a null author is one author."""
    first = items.groupBy("thread_id").agg(F.min_by("author", F.struct("pos", "author")).alias("_main"))
    marked = items.join(first, "thread_id").withColumn("_other", ~F.col("author").eqNullSafe(F.col("_main")))
    until = marked.groupBy("thread_id").agg(F.min(F.when(F.col("_other"), F.col("pos"))).alias("_until"))
    return marked.join(until, "thread_id").where("_until is null or pos < _until").drop("_main", "_other", "_until")
