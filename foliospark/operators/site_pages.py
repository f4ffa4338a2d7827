"""Pages of known kinds of sites: which reader takes an address, and threads read from the node relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_of, url_part
from .html_nodes import attribute, has_class

#: Readers in order, each with a pattern of hosts and one of paths.
READERS = (
    ("issue", r"^(?:www\.)?github\.com$", r"^/[^/]+/[^/]+/(?:issues|pull)/\d+"), ("repository", r"^(?:www\.)?github\.com$", r"^/[^/]+/[^/]+/?$"), ("news_thread", r"^news\.ycombinator\.com$", r"^/item"), ("forum_thread", r"^(?:www\.|old\.)?reddit\.com$", r"/comments/"),
    ("post", r"^(?:www\.|mobile\.)?(?:x|twitter)\.com$", r"/status/\d+"), ("article_post", r"^(?:www\.)?(?:x|twitter)\.com$", r"/(?:article|i/article)"), ("game_news", r"^store\.steampowered\.com$", r"^/news"), ("video", r"^(?:www\.)?youtube\.com$|^youtu\.be$", r"."), ("opus", r"(?:^|\.)bilibili\.com$", r"/(?:opus|read|video)"),
)


def reader_of(url: Column) -> Column:
    """The first reader whose patterns an address meets; null for other pages."""
    host, path = host_of(url_part(url, 2)), url_part(url, 3)
    found = F.lit(None).cast("string")
    for name, hosts, paths in reversed(READERS):
        found = F.when(host.rlike(hosts) & path.rlike(paths), name).otherwise(found)
    return found


def embed_address(src: Column) -> Column:
    """The page of an embedded player; null for other frames."""
    video = F.regexp_extract(src, r"(?:youtube(?:-nocookie)?\.com/embed/|youtu\.be/)([\w-]{6,})", 1)
    vimeo = F.regexp_extract(src, r"player\.vimeo\.com/video/(\d+)", 1)
    opus = F.regexp_extract(src, r"player\.bilibili\.com/player\.html\?.*?bvid=(\w+)", 1)
    post = F.regexp_extract(src, r"platform\.twitter\.com/embed/.*?[?&]id=(\d+)", 1)
    return F.when(video != "", F.concat(F.lit("https://www.youtube.com/watch?v="), video)).when(vimeo != "", F.concat(F.lit("https://vimeo.com/"), vimeo)).when(opus != "", F.concat(F.lit("https://www.bilibili.com/video/"), opus)).when(post != "", F.concat(F.lit("https://x.com/i/status/"), post))


def nested_comments(nodes: DataFrame, comment_class: str, author_class: str, body_class: str) -> DataFrame:
    """(thread_id, id, pos, parent_id, author, body): comments that are nested in each other, each with the nearest comment
    around it as its parent. Elements of a comment belong to the innermost one that holds them."""
    comments = nodes.where(has_class(comment_class)).select("page_id", F.col("pre").alias("c"), F.col("last").alias("z"))
    pairs = comments.alias("a").join(comments.alias("b"), "page_id").where("a.c > b.c and a.c <= b.z")
    parents = pairs.groupBy("page_id", F.col("a.c").alias("c")).agg(F.max("b.c").alias("parent"))
    held = nodes.where(has_class(author_class) | has_class(body_class)).select("page_id", "pre", "text", has_class(author_class).alias("is_author"))
    owner = held.join(comments, "page_id").where("pre between c and z").groupBy("page_id", "pre", "text", "is_author").agg(F.max("c").alias("c"))
    own = owner.groupBy("page_id", "c").agg(F.min_by(F.when(F.col("is_author"), F.col("text")), F.when(F.col("is_author"), F.col("pre"))).alias("author"), F.min_by(F.when(~F.col("is_author"), F.col("text")), F.when(~F.col("is_author"), F.col("pre"))).alias("body"))
    return comments.join(parents, ["page_id", "c"], "left").join(own, ["page_id", "c"], "left").select(F.col("page_id").alias("thread_id"), F.col("c").alias("id"), F.col("c").alias("pos"), F.col("parent").alias("parent_id"), "author", "body")


def indented_comments(nodes: DataFrame, row_class: str = "comtr", indent_class: str = "ind", author_class: str = "hnuser", body_class: str = "commtext") -> DataFrame:
    """(thread_id, id, pos, depth, author, body): comments in rows of a table whose depth is an attribute."""
    rows = nodes.where((F.col("tag") == "tr") & has_class(row_class)).select("page_id", F.col("pre").alias("c"), F.col("last").alias("z"), attribute("id").alias("row_id"))
    held = nodes.where(has_class(indent_class) | has_class(author_class) | has_class(body_class)).select("page_id", "pre", "text", attribute("indent").alias("indent"), has_class(author_class).alias("a"), has_class(body_class).alias("b"))
    joined = rows.join(held, "page_id").where("pre between c and z")
    return joined.groupBy("page_id", "c", "row_id").agg(F.coalesce(F.max(F.when(F.col("indent").rlike(r"^\d+$"), F.col("indent").try_cast("int"))), F.lit(0)).alias("depth"), F.max(F.when(F.col("a"), F.col("text"))).alias("author"), F.max(F.when(F.col("b"), F.col("text"))).alias("body")).select(
        F.col("page_id").alias("thread_id"), F.when(F.col("row_id") == "", F.concat(F.lit("comment-"), F.col("c").cast("string"))).otherwise(F.col("row_id")).alias("id"), F.col("c").alias("pos"), "depth", "author", "body"
    )


def bbcode_html(text: Column) -> Column:
    """Bulletin-board marks as HTML."""
    made = text
    for tag, html in (("b", "strong"), ("i", "em"), ("u", "u"), ("s", "del"), ("h1", "h1"), ("h2", "h2"), ("h3", "h3"), ("quote", "blockquote"), ("code", "code")):
        made = F.regexp_replace(made, rf"(?is)\[{tag}(?:=[^\]]*)?\](.*?)\[/{tag}\]", f"<{html}>$1</{html}>")
    made = F.regexp_replace(made, r"(?is)\[url=\"?([^\]\"]+)\"?\](.*?)\[/url\]", "<a href=\"$1\">$2</a>")
    made = F.regexp_replace(made, r"(?is)\[url\](.*?)\[/url\]", "<a href=\"$1\">$1</a>")
    made = F.regexp_replace(made, r"(?is)\[img\](.*?)\[/img\]", "<img src=\"$1\">")
    made = F.regexp_replace(F.regexp_replace(F.regexp_replace(made, r"(?i)\[list\]", "<ul>"), r"(?i)\[olist\]", "<ol>"), r"(?i)\[/(?:list)\]", "</ul>")
    return F.regexp_replace(F.regexp_replace(made, r"(?i)\[/olist\]", "</ol>"), r"\[\*\]([^\[<\n]*)", "<li>$1</li>")
