"""Results of repeated attempts, durations of jobs, and the choice of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _writes(log: DataFrame) -> DataFrame:
    """Finished attempts; a row delivered twice is one, reduced before any other shuffle."""
    ended = log.where(F.col("status").isin("completed", "failed") & F.col("item_key").isNotNull() & F.col("seq").isNotNull())
    return ended.groupBy("item_key", "seq").agg(F.max(F.struct("status", "output_path")).alias("w")).select("item_key", "seq", "w.*")


def kept_results(log: DataFrame) -> DataFrame:
    """(item_key, output_path, rolled_back, superseded): by item with a finished attempt, the output of its last
    completed attempt (null when none was completed), whether a later attempt failed, so that the item went back to that
    output, and how many other outputs of the item are superseded. Attempts without key or seq are left out."""
    writes = _writes(log)
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    by_output = writes.groupBy("item_key", "output_path").agg(F.max(F.when(done, F.col("seq"))).alias("done_at"), F.max(F.when(failed, F.col("seq"))).alias("failed_at"))
    one = by_output.groupBy("item_key").agg(
        F.max(F.when(F.col("done_at").isNotNull(), F.struct("done_at", "output_path"))).alias("last"), F.max("failed_at").alias("failed_at"),
        F.sum(F.when(F.col("done_at").isNotNull() & F.col("output_path").isNotNull(), 1).otherwise(0)).alias("outputs"),
    )
    kept = F.when(F.col("last.output_path").isNotNull(), 1).otherwise(0)
    return one.select("item_key", F.col("last.output_path").alias("output_path"), F.coalesce(F.col("failed_at") > F.col("last.done_at"), F.lit(False)).alias("rolled_back"), (F.col("outputs") - kept).alias("superseded"))


def superseded_outputs(log: DataFrame) -> DataFrame:
    """(item_key, output_path) of every completed output that is not the one kept for its item."""
    outputs = _writes(log).where("status = 'completed' and output_path is not null").select("item_key", "output_path").distinct()
    return outputs.join(kept_results(log).select("item_key", "output_path"), ["item_key", "output_path"], "left_anti")


def job_durations(items: DataFrame) -> DataFrame:
    """(job, op, duration_ms, created_ms, finished_ms) of items to (job, duration_ms): the longest item that was run
    again if any was; else the time from the job's creation to its end, at least 0; else the longest item; else null."""
    again = F.max(F.when(F.col("op") != "convert", F.col("duration_ms")))
    span = F.max("finished_ms") - F.min("created_ms")
    return items.groupBy("job").agg(F.coalesce(again, F.when(span.isNotNull(), F.greatest(F.lit(0), span)), F.max("duration_ms")).alias("duration_ms"))


def attempt_spans(log: DataFrame) -> DataFrame:
    """Items of a log as (job, op, duration_ms, created_ms, finished_ms): the job is the host; an item that failed before
    it was completed was run again."""
    ms = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("long")
    at, status = F.col("logged_at"), F.col("status")
    host = F.lower(F.regexp_extract("item_key", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    spans = log.where("item_key is not null").groupBy("item_key").agg(
        ms(F.min(at)).alias("created_ms"), ms(F.max(F.when(status != "in_progress", at))).alias("finished_ms"), F.min(F.when(status == "failed", F.col("seq"))).alias("failed"), F.max(F.when(status == "completed", F.col("seq"))).alias("done")
    )
    op = F.when(F.col("done") > F.col("failed"), "retry").otherwise("convert")
    return spans.select(host.alias("job"), op.alias("op"), (F.col("finished_ms") - F.col("created_ms")).alias("duration_ms"), "created_ms", "finished_ms")


def choose_model(draw: Column, needs_images: Column, now: Column, models: list[tuple[str, float, bool]], cooldowns: dict[str, float]) -> Column:
    """The model for a request: among ``models`` (name, weight, reads images) that can serve it and do not cool down at
    ``now``, the one whose share of the weights holds ``draw`` (0 to below 1). When all that can serve it cool down, the
    one that is ready first, by name on ties; null when none can. A null need is none, a null draw 0."""
    able = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(sees).alias("sees"), F.lit(float(cooldowns.get(name, 0.0))).alias("ready")) for name, weight, sees in models if weight > 0])
    able = F.filter(able, lambda m: m["sees"] | ~F.coalesce(needs_images, F.lit(False)))
    free = F.filter(able, lambda m: m["ready"] <= F.coalesce(now.cast("double"), F.lit(0.0)))
    total = F.aggregate(free, F.lit(0.0), lambda acc, m: acc + m["weight"])
    start = F.struct(F.coalesce(draw.cast("double"), F.lit(0.0)) * total, F.lit(None).cast("string")).cast("struct<left:double,name:string>")
    step = lambda acc, m: F.struct((acc["left"] - m["weight"]).alias("left"), F.when(acc["left"] >= 0, m["name"]).otherwise(acc["name"]).alias("name"))
    picked = F.aggregate(free, start, step, lambda acc: acc["name"])
    first = F.get(F.array_sort(F.transform(able, lambda m: F.struct(m["ready"].alias("ready"), m["name"].alias("name")))), 0)["name"]
    return F.coalesce(picked, first)
