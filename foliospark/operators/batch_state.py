"""State of batch runs: replay of the log, resume, counts, usage, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cache_tables import latest_rows

USAGE = ("requests", "input_tokens", "output_tokens", "cost_usd")


def replay(log: DataFrame) -> DataFrame:
    """The last state of each item: by seq, then by the time of writing, then by id; an interrupted item failed. Rows
    delivered twice change nothing."""
    last = latest_rows(log.select("item_key", "seq", "logged_at", "log_id", "status", "output_path", "error_text"), "item_key", "seq", "logged_at", "log_id")
    return last.select("item_key", "seq", F.when(F.col("status") == "in_progress", "failed").otherwise(F.col("status")).alias("status"), "output_path", "error_text")


def status_counts(state: DataFrame) -> DataFrame:
    """Totals of a run. What failed is pending again; what was skipped is among the completed."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    done, failed = F.col("status") == "completed", F.col("status") == "failed"
    return state.agg(F.count("*").alias("total"), n(done).alias("completed"), n(failed).alias("failed"), n(failed | (F.col("status") == "pending")).alias("pending"), n(done & F.col("output_path").isNull()).alias("skipped"))


def resume(state: DataFrame, found: DataFrame) -> DataFrame:
    """(item_key, action) of every known or found item: keep what was completed, retry what was not, add what is new,
    and leave out what is known but no longer found and completed."""
    known = state.select("item_key", "status")
    new = found.select("item_key").distinct().withColumn("found", F.lit(True))
    return known.join(new, "item_key", "full_outer").select(
        "item_key", F.when(F.col("status").isNull(), "new").when(F.col("status") == "completed", "keep").otherwise("retry").alias("action")
    )


def exit_code(completed: Column, failed: Column) -> Column:
    """0 when nothing failed, 10 when some did, 1 when nothing was completed."""
    return F.when(failed == 0, 0).when(completed > 0, 10).otherwise(1)


def usage_by_model(usage: DataFrame) -> DataFrame:
    """Sums by model over all items; a blank model is ``unknown``, a null counts as 0."""
    name = F.when(F.coalesce(F.col("model_name"), F.lit("")) == "", "unknown").otherwise(F.col("model_name"))
    return usage.groupBy(name.alias("model_name")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE[:3]], F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def usage_totals(usage: DataFrame) -> DataFrame:
    return usage.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE[:3]], F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def usage_of_items(usage: DataFrame) -> DataFrame:
    """By item: its models in order, and its sums."""
    return usage.groupBy("item_key").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("model_name", F.lit("")))), ",").alias("models"), F.sum("requests").alias("requests"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"))


def url_report(state: DataFrame) -> DataFrame:
    """By host: items, completed, failed and the share completed."""
    host = F.lower(F.regexp_extract("item_key", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    done, failed = F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0))
    return state.groupBy(host.alias("host")).agg(F.count("*").alias("total"), done.alias("completed"), failed.alias("failed"), F.round(done / F.count("*"), 6).alias("completed_share"))


def duration_text(seconds: Column) -> Column:
    """12.3s below a minute, mm:ss below an hour, else hh:mm:ss; null is 0s."""
    whole = F.floor(seconds).cast("long")
    two = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return (
        F.when(seconds.isNull(), "0s").when(seconds < 60, F.concat(F.format_string("%.1f", F.floor(seconds.cast("double") * 10 + 0.499999999) / 10), F.lit("s")))
        .when(seconds < 3600, F.concat(two(F.floor(whole / 60)), F.lit(":"), two(whole % 60)))
        .otherwise(F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60)))
    )


def item_durations(log: DataFrame) -> DataFrame:
    """By item: seconds from its first to its last row, and that as text."""
    span = (F.unix_micros(F.max("logged_at").cast("timestamp")) - F.unix_micros(F.min("logged_at").cast("timestamp"))) / 1_000_000
    return log.groupBy("item_key").agg(F.round(span, 3).alias("seconds")).select("item_key", "seconds", duration_text(F.col("seconds")).alias("shown"))


def attempts(log: DataFrame) -> DataFrame:
    """By item: its distinct writes, how often it failed and whether it was completed after a failure. Rows delivered
    twice are reduced before the shuffle by their seq."""
    once = log.groupBy("item_key", "seq").agg(F.max("status").alias("status"))
    fails = F.sum(F.when(F.col("status") == "failed", 1).otherwise(0))
    done = F.max(F.when(F.col("status") == "completed", F.col("seq")))
    first = F.min(F.when(F.col("status") == "failed", F.col("seq")))
    return once.groupBy("item_key").agg(F.count("*").alias("writes"), fails.alias("failures"), F.coalesce(done > first, F.lit(False)).alias("recovered"))


def free_name(names: DataFrame, suffix: str = ".md") -> DataFrame:
    """(item_key, name) to (item_key, output_name): the second and later items of a name get `` (2)``, `` (3)``, ...;
    case makes no difference. Ranks come from salted parts, so one name may hold any share of the items."""
    from ..plans.rank import ranked_within

    low = names.withColumn("_low", F.lower("name"))
    rank = ranked_within(low, ["_low"], ["item_key"])
    bare = F.regexp_replace("name", suffix.replace(".", r"\.") + "$", "")
    return rank.select("item_key", F.when(F.col("rank") == 0, F.col("name")).otherwise(F.concat(bare, F.lit(" ("), (F.col("rank") + 1).cast("string"), F.lit(")"), F.lit(suffix))).alias("output_name"))
