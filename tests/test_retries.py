from pyspark.sql import functions as F

from foliospark.operators import retries, threads


def test_a_failed_rerun_goes_back_to_the_prior_output(spark):
    rows = [("a", 1, "in_progress", None), ("a", 2, "completed", "a.md"), ("a", 3, "completed", "a.v2.md"), ("a", 4, "failed", None), ("a", 4, "failed", None), ("b", 1, "failed", None), ("c", 1, "completed", "c.md"), ("d", 1, "in_progress", None), (None, 1, "completed", "x"), ("c", None, "completed", "y")]
    log = spark.createDataFrame(rows, "item_key string, seq long, status string, output_path string")
    assert sorted(map(tuple, retries.kept_results(log).collect())) == [("a", "a.v2.md", True, 1), ("b", None, False, 0), ("c", "c.md", False, 0)]
    assert list(map(tuple, retries.superseded_outputs(log).collect())) == [("a", "a.md")]
    assert retries.kept_results(log.limit(0)).collect() == [] and retries.superseded_outputs(log.limit(0)).collect() == []


def test_durations_prefer_reruns_then_the_span_then_the_longest_item(spark):
    rows = [("a", "convert", 900, 0, 5000), ("a", "retry", 70, 0, 5000), ("a", "enhance", 80, 0, 5000), ("b", "convert", 10, 100, 400), ("c", "convert", 10, 100, 40), ("d", "convert", 7, None, 40), ("e", "convert", None, None, None)]
    items = spark.createDataFrame(rows, "job string, op string, duration_ms long, created_ms long, finished_ms long")
    assert sorted(map(tuple, retries.job_durations(items).collect())) == [("a", 80), ("b", 300), ("c", 0), ("d", 7), ("e", None)]


def test_models_are_chosen_by_weight_need_and_cooldown(spark):
    models = [("a", 1.0, False), ("b", 3.0, True), ("off", 0.0, True)]
    rows = [(0.0, False, 100), (0.24, False, 100), (0.25, False, 100), (0.99, None, 100), (0.0, True, 100), (0.9, False, 5), (0.9, False, 0), (None, None, None), (0.9, True, 0)]
    frame = spark.createDataFrame(rows, "d double, s boolean, t long")
    choose = retries.choose_model(F.col("d"), F.col("s"), F.col("t"), models, {"a": 4.0, "b": 10.0})
    assert [r[0] for r in frame.select(choose).collect()] == ["a", "a", "b", "b", "b", "a", "a", "a", "b"]
    assert frame.select(retries.choose_model(F.col("d"), F.lit(True), F.col("t"), [("a", 1.0, False)], {}).alias("x")).where("x is not null").count() == 0


def test_only_the_unbroken_run_of_the_first_author_stays(spark):
    rows = [("t", 1, "x"), ("t", 2, "x"), ("t", 3, "y"), ("t", 4, "x"), ("u", 1, None), ("u", 2, None), ("v", 5, "z")]
    items = spark.createDataFrame(rows, "thread_id string, pos int, author string")
    assert sorted((r["thread_id"], r["pos"]) for r in threads.leading_run(items).collect()) == [("t", 1), ("t", 2), ("u", 1), ("u", 2), ("v", 5)]
    assert threads.leading_run(items.limit(0)).collect() == []
