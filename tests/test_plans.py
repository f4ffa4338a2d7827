import os
import random

from pyspark.sql import functions as F

from foliospark.operators import batch_state, cache_tables, threads
from foliospark.plans import shared
from foliospark.plans.cut import keep_newest
from foliospark.plans.rank import ranked_within


def test_keep_newest_equals_brute_force(spark):
    rng = random.Random(4)
    for trial in range(4):
        rows = [(k, rng.choice((5, 5, 5, rng.randint(-1000, 1_000_000))), rng.randint(0, 50)) for k in range(300)]
        budget = rng.choice((0, 100, 2500, 100_000))
        kept, used = set(), 0
        for key, _, size in sorted(rows, key=lambda r: (-r[1], -r[0])):
            used += size
            if used > budget:
                break
            kept.add(key)
        frame = spark.createDataFrame(rows, "k long, at long, size long")
        assert {r["k"] for r in keep_newest(frame, budget, "size", "at", "k").collect()} == kept, trial


def test_ranks_of_a_hot_group(spark):
    rows = [("hot", f"{k:06d}") for k in range(3000)] + [("cold", "x"), ("cold", "a")]
    found = ranked_within(spark.createDataFrame(rows, "g string, o string"), ["g"], ["o"]).collect()
    assert {r["o"]: r["rank"] for r in found if r["g"] == "hot"} == {f"{k:06d}": k for k in range(3000)}
    assert {r["o"]: r["rank"] for r in found if r["g"] == "cold"} == {"a": 0, "x": 1}


def test_ranks_of_numbers_beyond_twelve_digits_and_nulls(spark):
    rows = [(g, 10**12 * k) for g in ("a", None) for k in (11, 2, 1, 100, 0)]
    found = ranked_within(spark.createDataFrame(rows, "g string, o long"), ["g"], ["o"]).collect()
    assert len(found) == 10 and all(r["rank"] == [0, 1, 2, 11, 100].index(r["o"] // 10**12) for r in found)


def test_scratch_removes_its_tables(spark, tmp_path):
    with shared.scratch(spark):
        kept = shared.materialise(spark.range(5), "five")
        path = kept.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert kept.count() == 5 and os.path.isdir("/" + path.lstrip("/"))
    assert not os.path.isdir("/" + path.lstrip("/"))


def test_upsert_keeps_the_new_and_evicts_the_old(spark):
    schema = "k long, v string, at long, size long"
    cache = spark.createDataFrame([(1, "old", 9, 10), (2, "b", 1, 10), (3, "c", 5, 10)], schema)
    fresh = spark.createDataFrame([(1, "new", 2, 10), (4, "d", 9, 10)], schema)
    found = cache_tables.upsert(cache, fresh, "k", 30, "size", "at", "k").collect()
    assert {(r["k"], r["v"]) for r in found} == {(1, "new"), (3, "c"), (4, "d")}


def test_replay_ignores_late_and_repeated_rows(spark):
    schema = "log_id long, item_key string, seq long, status string, output_path string, error_text string, logged_at timestamp_ntz"
    rows = [(1, "a", 1, "in_progress", None, None, None), (2, "a", 2, "completed", "o", None, None), (1, "a", 1, "in_progress", None, None, None), (3, "b", 1, "in_progress", None, None, None)]
    found = {r["item_key"]: r["status"] for r in batch_state.replay(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": "completed", "b": "failed"}


def test_durations(spark):
    found = spark.createDataFrame([(None,), (12.34,), (75.0,), (3725.0,)], "s double").select(batch_state.duration_text(F.col("s")).alias("t")).collect()
    assert [r["t"] for r in found] == ["0s", "12.3s", "01:15", "01:02:05"]


def test_thread_parents_and_paths(spark):
    rows = [("t", 0, 0, "a"), ("t", 1, 1, "b"), ("t", 2, 2, "c"), ("t", 3, 1, "d"), ("t", 4, 3, "e"), ("t", 5, 0, "f"), ("t", 6, 2, "g")]
    found = threads.parents_by_depth(spark.createDataFrame(rows, "thread_id string, pos int, depth int, id string"))
    assert {r["id"]: r["parent_id"] for r in found.collect()} == {"a": None, "b": "a", "c": "b", "d": "a", "e": None, "f": None, "g": None}
    paths = {r["id"]: r["depth"] for r in threads.reply_paths(found).collect()}
    assert paths == {"a": 0, "b": 1, "c": 2, "d": 1, "e": 0, "f": 0, "g": 0}
    rooted = threads.top_level(found.withColumn("root_id", F.lit("a")))
    assert {r["id"] for r in rooted.collect()} == {"a", "b", "d", "e", "f", "g"}


def test_batch_results_align(spark):
    schema = "batch_id string, pos int, image_index int, caption string, expected_count int"
    rows = [("ok", 0, 2, "two", 2), ("ok", 1, 1, "one", 2), ("twice", 0, 1, "x", 2), ("twice", 1, 1, "y", 2), ("short", 0, 5, "z", 3)]
    found = {(r["batch_id"], r["position"]): (r["caption"], r["cache_safe"]) for r in threads.align_results(spark.createDataFrame(rows, schema)).collect()}
    assert found == {("ok", 1): ("two", True), ("ok", 0): ("one", True), ("twice", 0): ("x", True), ("twice", 1): ("y", True), ("short", 0): ("z", False)}
