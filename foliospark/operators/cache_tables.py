"""Caches as tables: keys, lookups, upserts, eviction of the least recently used by bytes, expiry, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.cut import keep_newest

#: Days after its last hit at which a learned domain expires.
EXPIRY_DAYS = 30
PREVIEW = 200


def fetch_key(url: Column, strategy: Column | None = None, version: str = "v1") -> Column:
    """The key of a page in the cache: 32 hex digits over version, url and, when scoped, strategy."""
    parts = [F.lit(version), F.lit("\0"), url] + ([F.when(strategy.isNotNull(), F.concat(F.lit("\0"), strategy)).otherwise("")] if strategy is not None else [])
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def prompt_key(prompt: Column, model: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", prompt, model, F.sha2(content, 256)), 256), 1, 32)


def latest_rows(entries: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key: an upsert. The greatest of a struct is found with partial aggregation, so a key that
    holds any share of the rows is reduced before the shuffle."""
    rest = [c for c in entries.columns if c != key]
    newest = entries.groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"o{k}") for k, c in enumerate(order)], F.struct(*rest).alias("row"))).alias("best"))
    return newest.select(key, "best.row.*").select(*entries.columns)


def evict(entries: DataFrame, budget: int, size: str, touched: str, tie: str) -> DataFrame:
    """The entries that stay when the least recently touched are evicted until all fit into ``budget`` bytes."""
    return keep_newest(entries, budget, size, touched, tie)


def upsert(cache: DataFrame, fresh: DataFrame, key: str, budget: int, size: str, touched: str, tie: str) -> DataFrame:
    """Fresh rows replace those of the same key; then the least recently touched are evicted."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return evict(latest_rows(both, key, "_new", touched).drop("_new"), budget, size, touched, tie)


def cache_totals(entries: DataFrame, size: str) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"), F.round(F.coalesce(F.sum(size), F.lit(0)) / (1024 * 1024), 2).alias("size_mb"))


def totals_by(entries: DataFrame, group: str, size: str) -> DataFrame:
    """Entries and bytes by model or strategy; blank names are ``unknown``."""
    name = F.when(F.coalesce(F.col(group), F.lit("")) == "", "unknown").otherwise(F.col(group))
    return entries.groupBy(name.alias("name")).agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).alias("size_bytes"))


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def recent_entries(entries: DataFrame, limit: int, touched: str, tie: str, text: str) -> DataFrame:
    """The most recently touched entries with the beginning of their value (a top-k report)."""
    return entries.orderBy(F.col(touched).desc(), F.col(tie).desc()).limit(limit).select(tie, touched, preview(F.col(text)).alias("preview"))


def instant(text: Column) -> Column:
    """An ISO time; without a zone it is UTC. Null when it is none."""
    return F.try_to_timestamp(F.when(text.rlike(r"([+-]\d\d:?\d\d|Z)$"), text).otherwise(F.concat(text, F.lit("Z"))))


def is_expired(learned: Column, last_hit: Column, now: Column) -> Column:
    """More than EXPIRY_DAYS after the last hit, or after learning; also when neither can be read."""
    seen = instant(F.coalesce(F.nullif(last_hit, F.lit("")), learned))
    return F.coalesce(seen < now - F.expr(f"INTERVAL {EXPIRY_DAYS} DAYS"), F.lit(True))


def record_domains(known: DataFrame, urls: DataFrame, now: str) -> DataFrame:
    """Learned domains after recording ``urls``: one hit each; new domains are learned now."""
    fresh = urls.select(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("more"))
    both = known.join(fresh, "domain", "full_outer")
    return both.select("domain", F.coalesce("learned_at", F.lit(now)).alias("learned_at"), (F.coalesce("hits", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("hits"), F.when(F.col("more").isNotNull(), now).otherwise(F.col("last_hit")).alias("last_hit"))
