"""What surrounds the content within a page's content, found on the node relation.

Each rule gives the roots of the subtrees it would take out, as (page_id, pre, last, rule). ``removals`` joins the rules;
``report`` counts them by page and rule; ``html_nodes.without_subtrees`` takes them out. Positions within a page come
from its own totals, so every rule is a filter, or a join by page.

Rules depend on each other where one looks at what another leaves: a list ends a page once the notice below it is gone.
So they run in STAGES, each on the nodes that the stage before left; within a stage the rules do not meet. Nodes that
must stay (the content's root and what holds it, code, notes, the headers of articles) are never taken out by name or
score.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise
from .html_nodes import NOISE_WORDS, active_nodes, attribute, hidden_nodes, link_density, main_nodes, noise_nodes, small_images, without_subtrees

#: The texts by which the rules know their blocks.
BOILERPLATE = r"(?i)all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|privacy policy|terms of (?:use|service)|cookie (?:policy|preferences|settings)|^©"
NEWSLETTER = r"(?i)\b(?:newsletter|subscribe|sign up|abonnieren|abonnez-vous|suscríbete)\b"
RELATED = r"(?i)^(?:related|you may also like|read (?:next|more|also)|more (?:from|on|stories)|recommended|most read|das könnte sie auch interessieren|à lire aussi|también te puede interesar|mehr zum thema)\b"
SHARE = r"(?i)^(?:share|follow us|teilen|partager|compartir)\b"
LISTEN = r"(?i)\b(?:listen to (?:this|the) (?:article|story)|audio version)\b"
COUNTER = r"(?i)^[\d.,]+[km]?\s*(?:likes?|shares?|comments?|views?|claps?|replies|reposts)$"
CONTENTS = r"(?i)^(?:table of )?contents$|^on this page$|^in this article$|^inhalt(?:sverzeichnis)?$|^sommaire$|^índice$"
SENTENCE = r"[.!?。！？]"


def _rule(nodes: DataFrame, name: str, condition: Column) -> DataFrame:
    return nodes.where(condition).select("page_id", "pre", "last", F.lit(name).alias("rule"))


def with_page(nodes: DataFrame) -> DataFrame:
    """Adds the page's words and elements, the share of its elements before each node, and the characters of text before and
    behind it. A page's elements are one window of the page's size."""
    row = Window.partitionBy("page_id").orderBy("pre")
    page = Window.partitionBy("page_id")
    length = F.char_length(F.coalesce("own_text", F.lit("")))
    counted = nodes.select("*", F.max("words").over(page).alias("page_words"), (F.max("pre").over(page) + 1).alias("page_size"), F.sum(length).over(page).alias("_all"), F.coalesce(F.sum(length).over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("chars_before"))
    return counted.select("*", (F.col("pre") / F.col("page_size")).alias("place"), F.greatest(F.col("_all") - F.col("chars_before") - F.col("chars"), F.lit(0)).alias("chars_after")).drop("_all")


def breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Lists of a few short items of which most are links, near the top."""
    return _rule(nodes, "breadcrumbs", F.col("tag").isin("ol", "ul", "nav") & F.col("words").between(2, 24) & (link_density() > 0.5) & (F.col("place") < 0.3) & (F.lower(attribute("class")).rlike("bread|crumb|path") | F.lower(attribute("aria-label")).rlike("bread")))


def contents_lists(nodes: DataFrame) -> DataFrame:
    """Lists near the top of which nearly all text is links into the page."""
    inner = nodes.where((F.col("tag") == "a") & attribute("href").startswith("#")).select("page_id", F.col("pre").alias("_link"))
    lists = nodes.where(F.col("tag").isin("ul", "ol") & (F.col("place") < 0.4) & (link_density() > 0.8))
    counted = lists.join(inner, "page_id").where("_link between pre and last").groupBy("page_id", "pre", "last").agg(F.count("*").alias("n")).where("n >= 3")
    return counted.select("page_id", "pre", "last", F.lit("contents").alias("rule")).unionByName(_rule(nodes, "contents", F.col("tag").rlike("^(h[1-6]|p|div|strong)$") & F.col("text").rlike(CONTENTS)))


def related_sections(nodes: DataFrame) -> DataFrame:
    """From a heading of related pages to the end of its parent, past the middle of the page; and lists of links behind
    it."""
    heads = nodes.where(F.col("tag").rlike("^h[1-6]$|^p$|^div$|^strong$") & (F.col("words") <= 8) & F.col("text").rlike(RELATED) & (F.col("place") > 0.3)).select("page_id", F.col("pre").alias("h"), F.col("parent").alias("p"))
    parents = nodes.select("page_id", F.col("pre").alias("p"), F.col("last").alias("p_last"), F.col("tag").alias("p_tag"))
    spans = heads.join(parents, ["page_id", "p"], "left")
    return spans.select("page_id", F.col("h").alias("pre"), F.coalesce("p_last", "h").alias("last"), F.lit("related").alias("rule"))


def newsletters(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "newsletter", F.col("tag").isin("div", "section", "form", "p", "ul", "aside") & F.col("words").between(2, 60) & F.col("text").rlike(NEWSLETTER) & ~F.col("text").rlike(r"[.!?]\s.*[.!?]\s.*[.!?]\s"))


def boilerplate(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "boilerplate", F.col("tag").isin("p", "div", "footer", "section", "small", "aside") & F.col("words").between(1, 80) & F.col("text").rlike(BOILERPLATE) & (F.col("place") > 0.5))


def share_widgets(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "share", F.col("tag").isin("div", "ul", "p", "section", "aside", "span") & F.col("words").between(1, 15) & F.col("text").rlike(SHARE) & ~F.col("text").rlike(SENTENCE))


def listen_widgets(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "listen", (F.col("tag").isin("audio", "video") & (F.col("place") < 0.3)) | (F.col("tag").isin("div", "p", "section") & F.col("words").between(1, 25) & F.col("text").rlike(LISTEN)))


def counters(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "counter", F.col("text").rlike(COUNTER) & (F.col("words") <= 3))


def tag_blocks(nodes: DataFrame) -> DataFrame:
    """Short blocks of links at the very end."""
    return _rule(nodes, "tags", F.col("tag").isin("div", "ul", "p") & F.col("words").between(1, 10) & (link_density() >= 0.8) & (F.col("place") > 0.8))


def boundary_dates(nodes: DataFrame) -> DataFrame:
    """Times and short date blocks at either end."""
    return _rule(nodes, "date", ((F.col("tag") == "time") | (F.col("tag").isin("p", "div", "span") & (F.col("words") <= 6) & F.col("text").rlike(r"^(?:\d{1,2}\.? )?[A-Za-zÀ-ÿ]{3,10}\.? (?:\d{1,2}, )?\d{4}$|^\d{4}-\d{2}-\d{2}"))) & ((F.col("place") < 0.15) | (F.col("place") > 0.9)))


def bylines(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "byline", F.col("tag").isin("p", "div", "span", "address") & F.col("words").between(2, 8) & F.col("text").rlike(r"^(?:By|Von|Par|Por|Words by|Edited by)\s+[A-ZÀ-Þ]") & ~F.col("text").rlike(r"[.!?]$") & (F.col("place") < 0.5))


def read_times(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "read_time", (F.col("words") <= 6) & F.col("text").rlike(r"(?i)^\d+\s*(?:min(?:ute)?s?\.?)(?: read)?\b"))


def eyebrows(nodes: DataFrame) -> DataFrame:
    """The element right before the first heading, when it is a short label."""
    first = nodes.where(F.col("tag").isin("h1", "h2")).groupBy("page_id").agg(F.min(F.struct(F.when(F.col("tag") == "h1", 0).otherwise(1).alias("k"), "pre", "parent")).alias("h"))
    before = nodes.join(first.select("page_id", F.col("h.pre").alias("h_pre"), F.col("h.parent").alias("h_parent")), "page_id").where("parent = h_parent and last < h_pre")
    near = before.groupBy("page_id").agg(F.max(F.struct("pre", "last", "words", "text", "n_img", "tag")).alias("b"))
    good = (F.col("b.words").between(1, 6)) & (F.char_length("b.text") <= 40) & ~F.col("b.text").rlike(r"[.!?]$|\d{4}") & (F.col("b.n_img") == 0) & ~F.col("b.tag").isin("ul", "ol", "nav", "img", "figure", "time")
    return near.where(good).select("page_id", "b.pre", "b.last", F.lit("eyebrow").alias("rule"))


def trailing_thin(nodes: DataFrame) -> DataFrame:
    """Blocks at the end of the body of long pages that begin with a heading and say next to nothing."""
    blocks = nodes.where(F.col("tag").isin("section", "div") & (F.col("page_words") > 300) & (F.col("place") > 0.7) & (F.col("words") <= 25) & (F.col("n_p") < 2))
    heads = nodes.where(F.col("tag").rlike("^h[2-6]$")).select("page_id", F.col("parent").alias("pre")).distinct()
    return blocks.join(heads, ["page_id", "pre"], "left_semi").select("page_id", "pre", "last", F.lit("thin").alias("rule"))


#: Words of navigation, of an author's contact, and of what leads to other pages.
NAVIGATION = r"(?i)\b(?:home|menu|login|log in|sign in|sign up|search|contact|about|archive|next|previous|categories|tags|startseite|suche|accueil|inicio)\b"
CONTACT = r"(?i)\b(?:contact|e-?mail|write to|reach|follow|kontakt|contacto|contactez)\b"
ADDRESS = r"[\w.+-]+@[\w-]+\.[\w.]+|\+?\d[\d ()/-]{7,}\d"
MORE_ON = r"(?i)^(?:for more (?:on|about|information)|read more (?:on|about)|see also|more on|mehr (?:zu|über)|weitere informationen|pour en savoir plus|más sobre|más información)\b"
ZONE = r"^(?:UTC|GMT)(?: ?[+-]\d{1,2}(?::?\d\d)?)?$|^(?:[ECMP][SD]T|CES?T)$"
PINNED = r"(?i)^(?:pinned|featured|sponsored|angeheftet|épinglé|fijado)$"
#: Characters that must stand before related matter and boilerplate, and that count as either end of a page.
LEAD_CHARS, EDGE_CHARS = 500, 200


def _children(nodes: DataFrame) -> DataFrame:
    """(page_id, pre of the parent, and what its children are): sums over the children of each element."""
    card = (F.col("words").between(1, 40)) & (F.col("link_chars") > 0) & ((F.col("n_img") > 0) | (F.col("n_p") < 2))
    return nodes.where("parent >= 0").groupBy("page_id", F.col("parent").alias("pre")).agg(
        F.count("*").alias("n_children"), F.sum(card.cast("int")).alias("n_cards"), F.sum((link_density() > 0.8).cast("int")).alias("n_linked"), F.max("words").alias("longest"), F.sum((F.col("tag") == "p").cast("int")).alias("n_paragraphs"),
        F.sum(F.col("tag").isin("li", "dt", "dd").cast("int")).alias("n_items"), F.sum((F.col("tag").isin("p", "li") & (link_density() > 0.8)).cast("int")).alias("n_linked_items"),
    )


def _first_heading(nodes: DataFrame) -> DataFrame:
    """(page_id, h_pre): the first heading of level one, else of level two."""
    first = nodes.where(F.col("tag").isin("h1", "h2")).groupBy("page_id").agg(F.min(F.struct(F.when(F.col("tag") == "h1", 0).otherwise(1).alias("k"), "pre")).alias("h"))
    return first.select("page_id", F.col("h.pre").alias("h_pre"))


def _next_tag(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, next_tag, before_tag, before_text): an element's neighbours under the same parent."""
    row = Window.partitionBy("page_id", "parent").orderBy("pre")
    return nodes.select("page_id", "pre", F.lead("tag").over(row).alias("next_tag"), F.lag("tag").over(row).alias("before_tag"), F.lag("text").over(row).alias("before_text"))


def promo_banners(nodes: DataFrame) -> DataFrame:
    """Blocks of one link before the first heading, without pictures or a sentence."""
    linked = nodes.where(F.col("tag").isin("a", "p", "div") & (link_density() > 0.9) & F.col("words").between(1, 25) & (F.col("n_img") == 0) & ~F.col("text").rlike(SENTENCE + r"(?:\s|$)"))
    return linked.join(_first_heading(nodes), "page_id").where("last < h_pre").select("page_id", "pre", "last", F.lit("promo").alias("rule"))


def hero_headers(nodes: DataFrame) -> DataFrame:
    """The largest element above the first long paragraph that holds a heading and a time and next to no prose."""
    prose = nodes.where((F.col("tag") == "p") & (F.col("words") >= 30)).groupBy("page_id").agg(F.min("pre").alias("prose"))
    marks = nodes.where((F.col("tag") == "time") | F.col("tag").isin("h1", "h2")).select("page_id", F.col("pre").alias("m"), (F.col("tag") == "time").cast("int").alias("is_time"))
    boxes = nodes.where(F.col("tag").isin("header", "div", "section") & (F.col("words") < 60)).join(prose, "page_id").where("last < prose")
    held = boxes.join(marks, "page_id").where("m between pre and last").groupBy("page_id", "pre", "last").agg(F.sum("is_time").alias("times"), F.count("*").alias("all")).where("times > 0 and all > times")
    best = held.groupBy("page_id").agg(F.max(F.struct((F.col("last") - F.col("pre")).alias("size"), (-F.col("pre")).alias("o"), "pre", "last")).alias("b"))
    return best.select("page_id", "b.pre", "b.last", F.lit("hero").alias("rule"))


def orphan_contents(nodes: DataFrame) -> DataFrame:
    """Labels of a table of contents without a list behind them."""
    labels = nodes.where(F.col("tag").rlike("^(h[1-6]|p|div|strong)$") & F.col("text").rlike(CONTENTS))
    return labels.join(_next_tag(nodes), ["page_id", "pre"]).where(~F.coalesce(F.col("next_tag").isin("ul", "ol", "nav"), F.lit(False))).select("page_id", "pre", "last", F.lit("orphan_contents").alias("rule"))


def metadata_candidates(nodes: DataFrame) -> DataFrame:
    """Short elements that name a zone, say that a page is pinned, or repeat the page's title or description."""
    named = nodes.where((F.col("tag") == "title") | ((F.col("tag") == "meta") & F.lower(attribute("name")).isin("description", "og:title", "og:description"))).select("page_id", F.lower(F.when(F.col("tag") == "title", F.col("text")).otherwise(attribute("content"))).alias("said")).where("said <> ''").distinct()
    short = nodes.where(F.col("tag").isin("p", "div", "span", "small", "li") & F.col("words").between(1, 15))
    plain = short.where(F.col("text").rlike(ZONE) | F.col("text").rlike(PINNED))
    again = short.withColumn("said", F.lower("text")).join(named, ["page_id", "said"], "left_semi")
    return plain.select("page_id", "pre", "last").unionByName(again.select("page_id", "pre", "last")).withColumn("rule", F.lit("metadata"))


def metadata_lists(nodes: DataFrame) -> DataFrame:
    """Lists of one to eight short items near either end, with neither a heading nor a colon before them."""
    near = nodes.where(F.col("tag").isin("ul", "ol", "dl") & ((F.col("chars_before") < EDGE_CHARS) | (F.col("chars_after") < EDGE_CHARS)))
    sized = near.join(_children(nodes).select("page_id", "pre", "n_items", "longest"), ["page_id", "pre"]).where("n_items between 1 and 8 and longest <= 6")
    free = sized.join(_next_tag(nodes), ["page_id", "pre"]).where(~F.coalesce(F.col("before_tag").rlike("^h[1-6]$") | F.col("before_text").rlike(r"[:：]\s*$"), F.lit(False)))
    return free.select("page_id", "pre", "last", F.lit("metadata_list").alias("rule"))


def section_breadcrumbs(nodes: DataFrame) -> DataFrame:
    """Short blocks of one link to a folder above the page, by the address that the page gives as its own."""
    own = nodes.where((F.col("tag") == "link") & (F.lower(attribute("rel")) == "canonical")).groupBy("page_id").agg(F.min(F.regexp_extract(attribute("href"), r"^[a-z]+://[^/]*(/[^?#]*)", 1)).alias("path"))
    linked = nodes.where(F.col("tag").isin("p", "div", "span") & F.col("words").between(1, 6) & (link_density() > 0.8)).select("page_id", "pre", "last")
    targets = nodes.where(F.col("tag") == "a").select("page_id", F.col("pre").alias("a"), F.regexp_replace(F.regexp_extract(attribute("href"), r"^(?:[a-z]+://[^/]*)?(/[^?#]*)", 1), r"(?:index\.\w+)?$", "").alias("to")).where("to <> ''")
    above = linked.join(targets, "page_id").where("a between pre and last").join(own, "page_id").where(F.expr("startswith(path, rtrim('/', to) || '/') and path <> to"))
    return above.select("page_id", "pre", "last", F.lit("section_breadcrumb").alias("rule")).distinct()


def trailing_links(nodes: DataFrame) -> DataFrame:
    """A heading and a list at the end of which every item is mostly a link to another site."""
    lists = nodes.where(F.col("tag").isin("ul", "ol") & (F.col("chars_after") < EDGE_CHARS) & (link_density() > 0.6)).join(_children(nodes).select("page_id", "pre", "n_items", "n_linked_items"), ["page_id", "pre"]).where("n_items >= 2 and n_linked_items = n_items")
    away = nodes.where(F.col("tag") == "a").select("page_id", F.col("pre").alias("a"), attribute("href").rlike("^https?://").alias("away"))
    outward = lists.join(away, "page_id").where("a between pre and last").groupBy("page_id", "pre", "last", "parent").agg(F.bool_and("away").alias("all_away")).where("all_away")
    heads = nodes.where(F.col("tag").rlike("^h[2-6]$")).select("page_id", "parent", F.col("pre").alias("h"), F.col("last").alias("h_last"))
    return outward.join(heads, ["page_id", "parent"]).where("h_last = pre - 1").select("page_id", F.col("h").alias("pre"), "last", F.lit("trailing_links").alias("rule"))


def trailing_related(nodes: DataFrame) -> DataFrame:
    """The last container, when it is made of two or more paragraphs of links."""
    boxes = nodes.where(F.col("tag").isin("div", "section") & (F.col("chars_after") < 50)).join(_children(nodes).select("page_id", "pre", "n_children", "n_paragraphs", "n_linked_items"), ["page_id", "pre"])
    return boxes.where("n_paragraphs >= 2 and n_linked_items = n_paragraphs and n_children = n_paragraphs").select("page_id", "pre", "last", F.lit("related_posts").alias("rule"))


def related_intros(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "related_intro", (F.col("tag") == "p") & F.col("words").between(1, 20) & F.col("text").rlike(MORE_ON))


def related_cards(nodes: DataFrame) -> DataFrame:
    """Containers of which most children are cards, with a small part of the page's words, behind its beginning."""
    boxes = nodes.where(F.col("tag").isin("div", "section", "ul") & (F.col("chars_before") >= LEAD_CHARS) & (F.col("words") <= 0.3 * F.col("page_words")))
    return boxes.join(_children(nodes).select("page_id", "pre", "n_children", "n_cards"), ["page_id", "pre"]).where("n_children >= 3 and n_cards >= 0.7 * n_children").select("page_id", "pre", "last", F.lit("cards").alias("rule"))


def newsletter_lists(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "newsletter_list", (F.col("tag") == "ul") & F.col("words").between(1, 30) & F.col("text").rlike(NEWSLETTER))


def author_contacts(nodes: DataFrame) -> DataFrame:
    return _rule(nodes, "contact", F.col("tag").isin("p", "div", "section", "address") & F.col("words").between(2, 40) & (F.col("chars_after") < EDGE_CHARS) & F.col("text").rlike(CONTACT) & F.col("text").rlike(ADDRESS))


def protected_nodes(nodes: DataFrame) -> DataFrame:
    """(page_id, pre) of nodes that no name or score takes out: a page's content and what holds it, what stands in code, lists
    of notes, and headers right in an article, main part or section."""
    root = main_nodes(nodes).select("page_id", F.col("pre").alias("m"), F.col("last").alias("m_last"))
    holds = nodes.join(root, "page_id").where("pre <= m and last >= m_last").select("page_id", "pre")
    code = nodes.where(F.col("tag").isin("pre", "code")).select("page_id", F.col("pre").alias("c"), F.col("last").alias("c_last"))
    inside = nodes.join(code, "page_id").where("pre between c and c_last").select("page_id", "pre")
    notes = nodes.where(F.col("tag").isin("ol", "ul", "section", "div") & (attribute("class").rlike(r"(?i)\b(?:footnotes?|references|endnotes)\b") | attribute("id").rlike(r"(?i)^(?:footnotes?|references|endnotes)$"))).select("page_id", "pre")
    over = nodes.select("page_id", F.col("pre").alias("parent"), F.col("tag").alias("over"))
    heads = nodes.where(F.col("tag") == "header").join(over, ["page_id", "parent"]).where(F.col("over").isin("article", "main", "section")).select("page_id", "pre")
    return holds.unionByName(inside).unionByName(notes).unionByName(heads).distinct()


def likely_content() -> Column:
    """Blocks that no score takes out: those that hold code, a table or a picture with words, enough words for their
    paragraphs, or a sentence without many links."""
    few = link_density() < 0.5
    return F.col("tag").isin("pre", "code", "table", "figure", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") | ((F.col("words") >= 100) & few) | ((F.col("words") >= 50) & (F.col("n_p") >= 2) & few) | ((F.col("words") >= 30) & (F.col("n_p") >= 1) & few) | ((F.col("words") >= 10) & F.col("text").rlike(SENTENCE + r"(?:\s|$)") & (link_density() < 0.3))


def block_score() -> Column:
    """Commas for a block; words of navigation, links, short links and names of noise against it."""
    navigation = F.regexp_count("text", F.lit(NAVIGATION))
    return F.col("commas") - 10 * navigation - 15 * link_density() - F.when((F.col("words") < 10) & (link_density() > 0.5), 15).otherwise(0) - F.when(attribute("class").rlike(NOISE_WORDS), 8).otherwise(0)


def scored_blocks(nodes: DataFrame) -> DataFrame:
    """Blocks right in a page's content that are no likely content and score below nothing."""
    root = main_nodes(nodes).select("page_id", F.col("pre").alias("parent"))
    blocks = nodes.where(F.col("tag").isin("div", "section", "ul", "ol", "p", "aside", "nav", "header", "footer", "form")).join(root, ["page_id", "parent"])
    cards = blocks.join(_children(nodes).select("page_id", "pre", "n_children", "n_cards"), ["page_id", "pre"], "left")
    grid = F.when((F.col("n_children") >= 3) & (F.col("n_cards") >= 0.7 * F.col("n_children")), 15).otherwise(0)
    return cards.where(~likely_content() & (block_score() - grid < 0)).select("page_id", "pre", "last", F.lit("scored").alias("rule"))


def _unprotected(rule):
    def run(nodes: DataFrame) -> DataFrame:
        return rule(nodes).join(protected_nodes(nodes), ["page_id", "pre"], "left_anti")

    return run


def _plain(name: str, find) -> object:
    return lambda nodes: find(nodes).select("page_id", "pre", "last", F.lit(name).alias("rule"))


#: The rules in their order: what is not shown, what is named as noise, the page's top, its inside, its end, and then what
#: the end shows once that is gone.
STAGES = (
    (_plain("hidden", hidden_nodes), _plain("active", active_nodes), _plain("small_image", small_images)),
    (_unprotected(_plain("noise", noise_nodes)), _unprotected(scored_blocks), trailing_links),
    (eyebrows, breadcrumbs, promo_banners, hero_headers, listen_widgets, contents_lists),
    (orphan_contents, metadata_candidates, boundary_dates, bylines, read_times, metadata_lists, section_breadcrumbs, share_widgets, counters, newsletters, newsletter_lists, related_intros, related_cards),
    (boilerplate, related_sections, author_contacts, tag_blocks),
    (trailing_links, trailing_related, trailing_thin),
)


def removals(nodes: DataFrame) -> DataFrame:
    """The roots that the rules take out, stage by stage. What a stage leaves is written once, since each of its rules and
    the next stage read it."""
    left, found = nodes, []
    for stage in STAGES:
        placed = materialise(with_page(left), "placed-nodes")
        roots = materialise(reduce(DataFrame.unionByName, [rule(placed).select("page_id", "pre", "last", "rule") for rule in stage]), "noise-roots")
        found.append(roots)
        left = without_subtrees(placed.select(*nodes.columns), roots.select("page_id", "pre", "last"))
    return reduce(DataFrame.unionByName, found)


def outermost(roots: DataFrame) -> DataFrame:
    """Roots that are in no other root's subtree; nested removals then count once. A page's roots are few, so its window
    is small."""
    before = F.max("last").over(Window.partitionBy("page_id").orderBy("pre", F.col("last").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1))
    return roots.withColumn("_covered", before).where(F.col("_covered").isNull() | (F.col("pre") > F.col("_covered"))).drop("_covered")


def report(nodes: DataFrame) -> DataFrame:
    """(page_id, rule, removed): the outermost subtrees that each rule takes out of a page."""
    return outermost(removals(nodes)).groupBy("page_id", "rule").agg(F.count("*").alias("removed"))
