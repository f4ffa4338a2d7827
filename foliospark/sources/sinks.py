"""Sinks: Markdown with front matter, image records, keyed upserts into parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cache_tables import latest_rows
from ..plans.stored import StoredTable


def yaml_scalar(value: Column) -> Column:
    """A text as a quoted scalar."""
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"'), r"\s+", " "), F.lit('"'))


def frontmatter(fields: dict[str, Column]) -> Column:
    """A block of ``name: value`` lines between ``---`` lines, in order; nulls and blanks are left out."""
    lines = F.filter(F.array(*[F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"{name}: "), yaml_scalar(value))) for name, value in fields.items()]), lambda x: x.isNotNull())
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def with_frontmatter(text: Column, fields: dict[str, Column]) -> Column:
    return F.concat(frontmatter(fields), F.lit("\n"), text)


def write_markdown(documents: DataFrame, path: str, name: str, text: str) -> None:
    """One row a document, by name, as text partitions that other tools read; rewriting replaces the folder."""
    documents.select(F.col(name).alias("name"), F.col(text).alias("markdown")).write.mode("overwrite").parquet(path)


def upsert_table(spark: SparkSession, path: str, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """Upserts fresh rows into the table kept under ``path`` and returns it: the newest of each key stays. The union is
    written as a new base beside the old one, so readers are not disturbed and a failed write changes nothing. Fresh rows
    must have the table's columns; a table that cannot be read raises and is never taken for a missing one."""
    stored = StoredTable(spark, path)
    known = stored.read()
    both = fresh if known is None else known.unionByName(fresh)
    return stored.replace(latest_rows(both, key, order))
