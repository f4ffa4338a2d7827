"""Lists of urls, as text with one url a line or as a JSON array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_url_lists(files: DataFrame, name: str, content: str) -> DataFrame:
    """(file, pos, url, output_name): a JSON array of strings or objects, else lines with ``#`` comments and a name after a
    blank. Entries that are no http urls are left out; a JSON text that is no array has none."""
    is_json = F.ltrim(F.regexp_replace(F.col(content), r"^[\s﻿]+", "")).rlike(r"^[\[{]")
    items = F.from_json(content, "array<string>")
    entries = files.where(F.col(content).isNotNull() & is_json).select(F.col(name).alias("file"), F.posexplode(items).alias("pos", "item"))
    from_json = entries.select("file", "pos", F.when(F.col("item").startswith("{"), F.get_json_object("item", "$.url")).otherwise(F.col("item")).alias("url"), F.when(F.col("item").startswith("{"), F.get_json_object("item", "$.output_name")).alias("output_name"))
    lines = files.where(F.col(content).isNotNull() & ~is_json).select(F.col(name).alias("file"), F.posexplode(F.split(content, "\r?\n")).alias("pos", "line")).select("file", "pos", F.trim(F.regexp_replace("line", r"[\t\r]", " ")).alias("line")).where("line <> '' and line not like '#%'")
    rest = F.trim(F.regexp_extract("line", r"^\S+\s+(.*)$", 1))
    from_text = lines.select("file", "pos", F.regexp_extract("line", r"^(\S+)", 1).alias("url"), F.when(rest != "", F.regexp_replace(rest, "^([\"'])(.*)\\1$", "$2")).alias("output_name"))
    return from_json.unionByName(from_text).where(F.lower("url").rlike("^https?://"))
