"""Extraction of a page's content from its nodes, at several levels of strictness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise
from . import html_nodes, noise
from .page_metadata import linked_values

#: Words under which a level is given up for the next one.
ENOUGH_WORDS = 50
#: How many more words linked data must have than the extracted text to stand in for it.
SCHEMA_MARGIN = 3


def is_prose() -> Column:
    """Nodes of seven words and more with a sentence mark that are not mostly links."""
    return F.col("tag").isin("p", "blockquote", "li", "div", "section") & (F.col("words") >= 7) & F.col("text").rlike(r"[.!?。！？]") & (html_nodes.link_density() < 0.5) & ~F.col("text").rlike(r"^(?:By|Von|Par|Por)\s+[A-ZÀ-Þ]\S+(?: [A-ZÀ-Þ]\S+)?\s*$")


def content_start(nodes: DataFrame) -> DataFrame:
    """(page_id, start): the first prose block behind the first main heading, or of the page where it has none behind it."""
    heading = nodes.where(F.col("tag") == "h1").groupBy("page_id").agg(F.min("pre").alias("h"))
    prose = nodes.where(is_prose() & F.col("tag").isin("p", "blockquote", "li")).join(heading, "page_id", "left")
    behind = F.min(F.when(F.col("pre") > F.coalesce("h", F.lit(-1)), F.col("pre")))
    return prose.groupBy("page_id").agg(F.coalesce(behind, F.min("pre")).alias("start"))


def layout_tables(nodes: DataFrame) -> DataFrame:
    """Tables that lay out a page: wide, centred, of a content class, or with cells of a set width."""
    width = F.regexp_extract(html_nodes.attribute("width"), r"^(\d+)$", 1).try_cast("int")
    styled = F.regexp_extract(F.lower(html_nodes.attribute("style")), r"width\s*:\s*(\d+)px", 1).try_cast("int")
    wide = (F.coalesce(width, F.lit(0)) > 400) | (F.coalesce(styled, F.lit(0)) > 400) | (html_nodes.attribute("align") == "center") | F.lower(html_nodes.attribute("class")).rlike("content|article")
    cells = nodes.where((F.col("tag") == "td") & (html_nodes.attribute("width") != "")).select("page_id", F.col("pre").alias("_cell"))
    tables = nodes.where(F.col("tag") == "table")
    sized = tables.join(cells, "page_id").where("_cell between pre and last").select("page_id", "pre").distinct().withColumn("_sized", F.lit(True))
    return tables.join(sized, ["page_id", "pre"], "left").where(wide | F.col("_sized").isNotNull()).drop("_sized")


def table_content(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, last) of the cell that holds a page laid out by tables: the best of over 50 words, when it has at least
    half of the page's."""
    laid = layout_tables(nodes).select("page_id").distinct()
    pages = nodes.groupBy("page_id").agg(F.max("words").alias("_all"))
    cells = nodes.where((F.col("tag") == "td") & (F.col("words") > 50)).join(laid, "page_id").join(pages, "page_id").where("words * 2 >= _all")
    best = cells.groupBy("page_id").agg(F.max(F.struct(html_nodes.content_score().alias("s"), (-F.col("pre")).alias("o"), "pre", "last")).alias("b"))
    return best.select("page_id", "b.pre", "b.last")


def _words_left(nodes: DataFrame, roots: DataFrame, spans: DataFrame) -> DataFrame:
    left = html_nodes.without_subtrees(nodes, roots).join(spans, "page_id").where("pre between _a and _b")
    bare = F.regexp_replace(F.col("own_text"), r"[^\p{L}\p{N}_\s]", " ")
    words = F.size(F.filter(F.split(F.trim(bare), r"\s+"), lambda w: w != ""))
    return left.groupBy("page_id").agg(F.coalesce(F.sum(words), F.lit(0)).alias("n"))


def extraction_levels(nodes: DataFrame) -> DataFrame:
    """(page_id, level, words): the level at which each page is extracted. Level 1 takes out all that is hidden or around;
    level 2 keeps what only its classes speak against, and must more than double a poor level 1; level 3 keeps hidden
    elements too, level 4 the whole page, and each must have more words than the one before."""
    main = html_nodes.main_nodes(nodes).select("page_id", F.col("pre").alias("_a"), F.col("last").alias("_b"))
    whole = nodes.groupBy("page_id").agg(F.min("pre").alias("_a"), F.max("last").alias("_b"))
    span = ("page_id", "pre", "last")
    act, hid, cls = html_nodes.active_nodes(nodes).select(*span), html_nodes.hidden_nodes(nodes).select(*span), html_nodes.noise_nodes(nodes).select(*span)
    rules = materialise(noise.outermost(noise.removals(nodes)).select(*span), "removals")
    levels = [(reduce(DataFrame.unionByName, (act, hid, cls, rules)), main), (act.unionByName(hid), main), (act, main), (act, whole)]
    found = reduce(lambda a, b: a.join(b, "page_id", "full_outer"), [_words_left(nodes, roots, spans).withColumnRenamed("n", f"n{k}") for k, (roots, spans) in enumerate(levels, 1)])
    n = [F.coalesce(F.col(f"n{k}"), F.lit(0)) for k in range(1, 5)]
    level = F.lit(1)
    words = n[0]
    for k in (2, 3, 4):
        better = (words < ENOUGH_WORDS) & (n[k - 1] > (2 * words if k == 2 else words))
        level, words = F.when(better, k).otherwise(level), F.when(better, n[k - 1]).otherwise(words)
    return found.select("page_id", level.alias("level"), words.cast("long").alias("words"))


def schema_bodies(nodes: DataFrame) -> DataFrame:
    """(page_id, body, schema_words): the text in the linked data of pages that have one."""
    body = F.trim(F.regexp_replace("body", r"\s+", " "))
    return linked_values(nodes).where("body is not null").select("page_id", body.alias("body"), F.size(F.split(body, " ")).alias("schema_words"))


def schema_fallback(nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    """(page_id, text, from_schema): extracted texts (page_id, text), replaced by the text of the linked data where that has
    SCHEMA_MARGIN words more."""
    own = F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    better = F.coalesce(F.col("schema_words") >= own + SCHEMA_MARGIN, F.lit(False))
    return extracted.join(schema_bodies(nodes), "page_id", "left").select("page_id", F.when(better, F.col("body")).otherwise(F.col("text")).alias("text"), better.alias("from_schema"))


def smallest_holder(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(page_id, pre): the smallest block whose text holds that of ``texts`` (page_id, body)."""
    joined = nodes.where(F.col("tag").isin("article", "section", "main", "div", "p", "body")).join(texts, "page_id").where(F.contains("text", F.col("body")))
    return joined.groupBy("page_id").agg(F.min(F.struct("chars", (-F.col("pre")).alias("p"))).alias("b")).select("page_id", (-F.col("b.p")).alias("pre"))
