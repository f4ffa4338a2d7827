"""Reports of runs as JSON texts with keys in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batch_state import duration_text, usage_of_items


def item_reports(state: DataFrame, usage: DataFrame) -> DataFrame:
    """(item_key, report): one JSON text for each item: status, output, error, models, tokens and cost. Nulls are left
    out."""
    joined = state.join(usage_of_items(usage), "item_key", "left")
    body = F.struct("status", F.col("output_path").alias("output"), F.col("error_text").alias("error"), F.when(F.col("models").isNotNull(), F.struct("models", "requests", "tokens", "cost_usd")).alias("usage"))
    return joined.select("item_key", F.to_json(body).alias("report"))


def run_report(state: DataFrame, log: DataFrame) -> DataFrame:
    """(report): totals of a run with its wall time, as one JSON text."""
    times = log.agg(F.min("logged_at").alias("a"), F.max("logged_at").alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    totals = state.agg(F.count("*").alias("total"), n(F.col("status") == "completed").alias("completed"), n(F.col("status") == "failed").alias("failed"))
    wall = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 1_000_000
    one = totals.withColumn("_k", F.lit(1)).join(times.withColumn("_k", F.lit(1)), "_k")
    return one.select(F.to_json(F.struct(F.struct("total", "completed", "failed").alias("summary"), duration_text(wall).alias("duration"))).alias("report"))


def by_source(items: DataFrame, source: str) -> DataFrame:
    """(source, report): a JSON text for each source with its counts."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    sums = items.groupBy(source).agg(F.count("*").alias("total"), n(F.col("status") == "completed").alias("completed"), n(F.col("status") == "failed").alias("failed"))
    return sums.select(source, F.to_json(F.struct("total", "completed", "failed")).alias("report"))


def stale(jobs: DataFrame, touched: str, now: Column, days: int) -> DataFrame:
    """Jobs that were not touched for ``days``."""
    return jobs.where(F.col(touched) < now - F.make_interval(days=F.lit(days)))


def pool_name(models: list[tuple[str, float]]) -> str:
    """A name of a set of models with a weight: the same for every order and repetition."""
    import hashlib

    names = sorted({m for m, weight in models if weight > 0})
    return "pool:" + (hashlib.sha256("\n".join(names).encode()).hexdigest()[:16] if names else "none")


def task_hash(options: dict) -> str:
    """Six hex digits over sorted options."""
    import hashlib
    import json

    return hashlib.md5(json.dumps(options, sort_keys=True, default=str).encode()).hexdigest()[:6]  # noqa: S324  a name, no secret


JOB = "job_id string, status string, created_at double, finished_at double, items array<struct<name:string,output:string,error:string>>"
#: States in which a job is over.
ENDED = ("completed", "failed", "cancelled")


def write_jobs(jobs: DataFrame, path: str) -> None:
    """Adds snapshots of jobs, a JSON text a row; the last one of a job holds."""
    jobs.select("job_id", F.to_json(F.struct(*jobs.columns)).alias("value"), F.current_timestamp().alias("written_at")).write.mode("append").parquet(path)


def read_jobs(snapshots: DataFrame, live: DataFrame) -> DataFrame:
    """The jobs of written snapshots that are over and not among the live ones. Texts that are no job are left out."""
    last = snapshots.groupBy("job_id").agg(F.max_by("value", "written_at").alias("value"))
    jobs = last.select(F.from_json("value", JOB).alias("job")).select("job.*").where("job_id is not null").where(F.col("status").isin(*ENDED))
    return jobs.join(live.select("job_id").distinct(), "job_id", "left_anti")


def recorded_run(items: DataFrame, job: str, started: Column) -> DataFrame:
    """A run's outcomes (name, output, error) as one job, whose outputs have names of their own."""
    from .batch_state import free_name

    named = free_name(items.select(F.col("output").alias("name"), F.col("name").alias("item_key"))).withColumnRenamed("item_key", "name")
    rows = items.drop("output").join(named.withColumnRenamed("output_name", "output"), "name")
    one = rows.agg(F.sort_array(F.collect_list(F.struct("name", "output", "error"))).alias("items"), F.max(F.col("error").isNotNull()).alias("_bad"))
    return one.select(F.lit(job).alias("job_id"), F.when(F.col("_bad"), "failed").otherwise("completed").alias("status"), started.cast("double").alias("created_at"), F.unix_timestamp().cast("double").alias("finished_at"), "items")
