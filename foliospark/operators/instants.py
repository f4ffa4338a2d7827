"""Timestamps of mixed format and zone, normalised to one instant in UTC.

Raw strings are reduced to a dictionary of the distinct (raw, zone, order), each entry is parsed once, the
dictionary can be kept and extended by later runs, and its instants are joined back to the rows.

Defined cases: null, blank, relative and impossible values have no row in the result; repeated values and repeated
rows each get their own row; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timestamps import parse_instant
from ..functions.web import source_key
from ..plans.shared import materialise, shared_dir
from ..plans.skew import lookup
from ..plans.stored import MOST_DELTAS, StoredTable
from ..sources.tables import table

ENTRY = "key string, raw string, zone string, date_order string, utc_us long"


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        batch["utc_us"] = pd.array([parse_instant(r, z, o) for r, z, o in zip(batch["raw"], batch["zone"], batch["date_order"])], dtype="Int64")
        yield batch[["key", "raw", "zone", "date_order", "utc_us"]]


def _key() -> F.Column:
    return F.concat_ws("\u0001", "raw", F.coalesce("zone", F.lit("")), F.coalesce("date_order", F.lit("")))


def distinct_values(values: DataFrame) -> DataFrame:
    """(key, raw, zone, date_order, n): each distinct value with its rows."""
    return values.where(F.trim("raw") != "").withColumn("key", _key()).groupBy("key", "raw", "zone", "date_order").agg(F.count("*").alias("n"))


def extend_dictionary(stored: StoredTable, fresh: DataFrame) -> DataFrame:
    """Parses the distinct values that the stored dictionary does not hold, adds them as a delta and returns the whole
    dictionary, one row a key. What a value denotes depends on the value alone, so entries never go stale. Two writers
    at a time may add a key twice: readers and the next compaction keep one of the two equal rows."""
    known = stored.read(ENTRY)
    lacking = fresh if known is None else fresh.join(known.select("key").distinct(), "key", "left_anti")
    stored.append(lacking.select("key", "raw", "zone", "date_order").mapInPandas(_parse, ENTRY))
    whole = stored.read(ENTRY).dropDuplicates(["key"]) if known is not None else stored.read(ENTRY)
    return stored.replace(whole) if stored.deltas() >= MOST_DELTAS else whole


def normalise_instants(values: DataFrame, stored: StoredTable) -> DataFrame:
    """(field_name, row_id, raw, zone, date_order) to (field_name, row_id, utc_us), one row for each value that
    denotes exactly one instant, through the stored dictionary, which grows by the values it lacks. How often a value
    stands in the rows is counted anew, so hot values are those of these rows."""
    fresh = materialise(distinct_values(values), "distinct-instants")
    known = extend_dictionary(stored, fresh.drop("n"))
    entries = materialise(fresh.select("key", "n").join(known.select("key", "utc_us"), "key"), "instants")
    total = entries.agg(F.sum("n")).first()[0] or 0
    rows = values.where(F.trim("raw") != "").select("field_name", "row_id", _key().alias("key"))
    return lookup(rows, entries, "key", total, F.col("utc_us").isNotNull()).select("field_name", "row_id", "utc_us")


def timestamp_values(pages: DataFrame, metadata: DataFrame, sites: DataFrame) -> DataFrame:
    """The raw values of published (local time of their site) and last_modified (UTC)."""
    home = sites.select(source_key(F.col("domain")).alias("site_key"), F.col("home_zone").alias("zone"), "date_order").dropDuplicates(["site_key"])
    # sites has one row for each listed site and stays small beside the data; Spark broadcasts it below its own threshold
    published = metadata.select(
        F.lit("published").alias("field_name"), F.col("meta_id").alias("row_id"), F.col("published").alias("raw"), source_key(F.col("domain")).alias("site_key")
    ).where("raw is not null").join(home, "site_key", "left").drop("site_key")
    modified = pages.select(
        F.lit("last_modified").alias("field_name"), F.col("fetch_id").alias("row_id"), F.col("last_modified").alias("raw"), F.lit("UTC").alias("zone"), F.lit(None).cast("string").alias("date_order")
    ).where("raw is not null")
    return published.unionByName(modified)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Through the dictionary in the shared folder: what an earlier run parsed is not parsed again."""
    values = timestamp_values(table(spark, folder, "fetch_cache"), table(spark, folder, "web_metadata"), table(spark, folder, "sites"))
    return normalise_instants(values, StoredTable(spark, f"{shared_dir(spark)}/instant-dictionary"))
