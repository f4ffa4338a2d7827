"""Metadata of HTML pages, from meta elements and linked data, with fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let
from .html_nodes import attribute

SEPARATORS = (" | ", " - ", " – ", " — ", " · ", " :: ")
LONGEST_TITLE = 300


def clean_title(title: Column, site: Column) -> Column:
    """Blanks collapsed, the site's name taken off either end (twice at most), cut at the last blank before
    LONGEST_TITLE."""
    name = collapse(site)

    def strip(text: Column, sep: Column) -> Column:
        tail, head = F.concat(sep, name), F.concat(name, sep)
        return F.when(name.isNotNull() & F.endswith(text, tail), F.substring(text, F.lit(1), F.char_length(text) - F.char_length(tail))).when(name.isNotNull() & F.startswith(text, head), F.substring(text, F.char_length(head) + 1, F.char_length(text))).otherwise(text)

    text = F.aggregate(F.array(*[F.lit(sep) for sep in SEPARATORS * 2]), collapse(title), strip)
    return let(text, _shortened)


def _shortened(text: Column) -> Column:
    cut = F.substring(text, 1, LONGEST_TITLE)
    return F.when(F.char_length(text) > LONGEST_TITLE, F.concat(F.regexp_replace(cut, r"\s\S*$", ""), F.lit("…"))).otherwise(text)


def meta_contents(nodes: DataFrame) -> DataFrame:
    """(page_id, name, content): the first content of each name or property, in lower case."""
    rows = nodes.where((F.col("tag") == "meta") & (F.trim(attribute("content")) != "")).select("page_id", "pre", F.explode(F.array(F.lower(attribute("name")), F.lower(attribute("property")))).alias("name"), F.trim(attribute("content")).alias("content")).where("name <> ''")
    return rows.groupBy("page_id", "name").agg(F.min_by("content", "pre").alias("content"))


def linked_data(nodes: DataFrame) -> DataFrame:
    """(page_id, doc): each object of the page's linked data; lists and graphs are flattened, what does not parse is left
    out."""
    scripts = nodes.where((F.col("tag") == "script") & (F.lower(attribute("type")) == "application/ld+json")).select("page_id", "pre", F.col("own_text").alias("json"))
    whole = scripts.select("page_id", "pre", F.try_parse_json("json").alias("v")).where("v is not null")
    flat = whole.select("page_id", "pre", F.explode(F.coalesce(F.expr("try_variant_get(v, '$', 'array<variant>')"), F.array("v"))).alias("v"))
    graph = flat.select("page_id", "pre", F.explode(F.concat(F.array("v"), F.coalesce(F.expr("try_variant_get(v, '$[\"@graph\"]', 'array<variant>')"), F.expr("array()")))).alias("doc"))
    return graph


def linked_values(nodes: DataFrame) -> DataFrame:
    """(page_id, headline, name, author, date_published, body): the first value of each over the page's linked data."""
    docs = linked_data(nodes)
    text = lambda path: F.nullif(F.trim(F.expr(f"try_variant_get(doc, '$.{path}', 'string')")), F.lit(""))
    author = F.coalesce(F.nullif(F.expr("try_variant_get(doc, '$.author.name', 'string')"), F.lit("")), F.expr("try_variant_get(doc, '$.author[0].name', 'string')"), text("author"))
    rows = docs.select("page_id", "pre", text("headline").alias("headline"), text("name").alias("name"), author.alias("author"), text("datePublished").alias("date_published"), F.coalesce(text("articleBody"), text("text")).alias("body"))
    return rows.groupBy("page_id").agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in ("headline", "name", "author", "date_published", "body")])


def page_metadata(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, title, author, site, published, description, canonical_url) of each of ``pages`` (page_id, url). A
    canonical address that is a site's root is left out where the page is deeper; nothing stands in for what is
    missing."""
    metas = meta_contents(nodes).groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("meta"))
    own = nodes.groupBy("page_id").agg(
        F.min_by(F.when((F.col("tag") == "title") & (F.col("own_text") != ""), F.col("own_text")), F.when((F.col("tag") == "title") & (F.col("own_text") != ""), F.col("pre"))).alias("own_title"),
        F.min_by(F.when(F.col("tag") == "h1", F.col("text")), F.when(F.col("tag") == "h1", F.col("pre"))).alias("h1"),
        F.min_by(F.when((F.col("tag") == "time") & attribute("datetime").rlike(r"^\d{4}-\d{2}"), F.trim(attribute("datetime"))), F.when((F.col("tag") == "time") & attribute("datetime").rlike(r"^\d{4}-\d{2}"), F.col("pre"))).alias("time"),
        F.min_by(F.when((F.col("tag") == "link") & (F.lower(attribute("rel")) == "canonical"), attribute("href")), F.when((F.col("tag") == "link") & (F.lower(attribute("rel")) == "canonical"), F.col("pre"))).alias("canonical"),
    )
    joined = pages.select("page_id", "url").join(own, "page_id", "left").join(metas, "page_id", "left").join(linked_values(nodes), "page_id", "left")
    meta = lambda name: F.element_at("meta", F.lit(name))
    site = F.coalesce(meta("og:site_name"), meta("application-name"))
    title = F.coalesce(*[clean_title(c, site) for c in (F.col("headline"), F.col("name"), F.col("own_title"), meta("og:title"))])
    longer = F.when(F.endswith(title, F.lit("…")) & F.startswith(meta("og:title"), F.expr("substring(coalesce(own_title, ''), 1, 20)")), clean_title(meta("og:title"), site))
    headed = F.when(F.startswith(title, F.concat(F.col("h1"), F.lit(" | "))), F.col("h1"))
    root = F.col("canonical").rlike(r"^https?://[^/]+/?$") & ~F.col("url").rlike(r"^https?://[^/]+/?$")
    return joined.select(
        "page_id", F.coalesce(headed, longer, title).alias("title"), F.coalesce(meta("author"), F.col("author")).alias("author"), site.alias("site"),
        F.coalesce(meta("article:published_time"), F.col("date_published"), F.col("time")).alias("published"), F.coalesce(meta("description"), meta("og:description")).alias("description"),
        F.when(~root, F.col("canonical")).alias("canonical_url"),
    )
