"""Sections of paged documents before and after a rewriting stage, and which of the rewritten ones are taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let

MARK = r"<!-- (Page|Slide) (?:number: ?)?(\d+) -->"


def sections(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, section_id, body) of the parts behind the marks of a text."""
    ids = F.transform(F.regexp_extract_all(text_column, F.lit(MARK), 0), lambda m: F.concat(F.lower(F.regexp_extract(m, MARK, 1)), F.lit(":"), F.regexp_extract(m, MARK, 2)))
    bodies = let(F.split(text_column, MARK, -1), lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda b: F.trim(b)))
    return texts.where(F.col(text_column).rlike(MARK)).select(id_column, F.posexplode(F.arrays_zip(ids.alias("section_id"), bodies.alias("body"))).alias("pos", "x")).select(id_column, "pos", "x.section_id", "x.body")


def plain_text(body: Column) -> Column:
    """What a section says, without marks, images and comments."""
    return collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", " "), r"!\[[^\]]*\]\([^)]*\)", " "), r"[#*_`>|-]", " "))


def grew_too_much(before: Column, after: Column) -> Column:
    """Whether a section grew past what rewriting explains: from nothing to over 200 characters, a short one past double
    and 80 more, a long one past double and 800 more."""
    a, b = F.char_length(plain_text(before)), F.char_length(plain_text(after))
    return F.when(a == 0, b > 200).when(a < 400, b > F.greatest(2 * a, a + 80)).otherwise(b > F.greatest(2 * a, a + 800))


def stabilised(before: DataFrame, after: DataFrame, id_column: str) -> DataFrame:
    """(id, pos, section_id, body, taken_back): the sections after rewriting. A document whose section marks changed is
    taken back whole; else a section is taken back that grew too much, lost all it said, or got text where there was an
    image alone."""
    order = lambda df: df.groupBy(id_column).agg(F.array_sort(F.collect_list(F.struct("pos", "section_id"))).alias("ids"))
    drift = order(before).join(order(after).withColumnRenamed("ids", "new_ids"), id_column, "left").select(id_column, F.coalesce(F.transform("ids", lambda x: x["section_id"]) != F.transform("new_ids", lambda x: x["section_id"]), F.lit(True)).alias("drift"))
    joined = before.join(after.select(id_column, "pos", F.col("body").alias("new_body")), [id_column, "pos"], "left").join(drift, id_column)
    said, says = plain_text(F.col("body")), plain_text(F.coalesce("new_body", F.lit("")))
    injected = F.contains("body", F.lit("![")) & (said == "") & (says != "")
    back = F.col("drift") | F.col("new_body").isNull() | grew_too_much(F.col("body"), F.col("new_body")) | ((said != "") & (says == "")) | injected
    return joined.select(id_column, "pos", "section_id", F.when(back, F.col("body")).otherwise(F.col("new_body")).alias("body"), back.alias("taken_back"))


def fingerprint(text: Column, pages: Column) -> Column:
    """A hash over the first 50,000 characters and the first 50 page names."""
    return F.sha2(F.concat_ws("|", F.substring(text, 1, 50_000), F.array_join(F.slice(pages, 1, 50), ",")), 256)


def batches(items: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch_no: items of a group in order, ``size`` at a time."""
    from ..plans.rank import ranked_within

    return ranked_within(items, [group], [order]).withColumn("batch_no", F.floor(F.col("rank") / size).cast("int")).drop("rank")


def rendered_prompt(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` replaced by the text of a column; other braces stay."""
    made = F.lit(template)
    for name, value in values.items():
        made = F.replace(made, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return made


def foreign_images(text: Column, source: Column) -> Column:
    """Remote images of a text that its source does not have."""
    remote = lambda t: F.regexp_extract_all(t, F.lit(r"!\[[^\]]*\]\((https?://[^)\s]+)\)"), 1)
    return F.array_except(remote(text), remote(source))
