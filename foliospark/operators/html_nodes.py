"""HTML as a relation of nodes, and operators on it.

``parse_nodes`` turns each page into rows with the place of each element in the tree: ``pre`` numbers elements in
document order, ``last`` is the greatest ``pre`` in an element's subtree, so a subtree is an interval. Counts over each
subtree (words, commas, paragraphs, images, link text) are gathered while parsing. What follows is relational.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag, and elements that end an open paragraph or item of their kind.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
ENDS_SAME = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
RAW = frozenset(("script", "style", "template", "noscript"))
_CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]")


class TreeBuilder(HTMLParser):
    """Elements in document order from tolerant parsing: unclosed paragraphs, items and cells end where they must, end
    tags without a start are left out, and what is open at the end is closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close_to("p", BLOCKS - {"p"})
        if tag in ENDS_SAME:
            self._close_to(tag, frozenset(ENDS_SAME[tag]))
        parent = self.open[-1] if self.open else -1
        self.nodes.append([parent, tag, {k: v or "" for k, v in attrs}, [], len(self.nodes)])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open:
            self._end(len(self.open) - 1)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[at]][1] == tag:
                self._end(at)
                return

    def handle_data(self, data):
        if self.open and data:
            self.nodes[self.open[-1]][3].append((len(self.nodes), data))

    def _close_to(self, tag: str, stops: frozenset) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.nodes[self.open[at]][1]
            if name == tag:
                self._end(at)
                return
            if name in stops:
                return

    def _end(self, at: int) -> None:
        last = len(self.nodes) - 1
        for k in self.open[at:]:
            self.nodes[k][4] = last
        del self.open[at:]

    def finish(self) -> list[list]:
        self.close()
        self._end(0)
        return self.nodes


def build(html: str) -> list[list]:
    """[parent, tag, attributes, [(before element, text)], last] of each element of a page, in document order."""
    parser = TreeBuilder()
    parser.feed(html)
    return parser.finish()


def words_in(text: str) -> int:
    """Each CJK character is a word; the rest counts by blanks, without punctuation."""
    return len(_CJK.findall(text)) + len(re.sub(r"[^\w\s]", " ", _CJK.sub(" ", text)).split())


NODES = "pre int, parent int, last int, depth int, tag string, attrs map<string,string>, own_text string, text string, words int, commas int, n_p int, n_img int, link_chars int, chars int"


def node_rows(html: str) -> list[tuple]:
    nodes = build(html)
    if not nodes:
        return []
    size = len(nodes)
    depth = [0] * size
    pieces: list[list[tuple[int, int, str]]] = [[] for _ in range(size)]
    for k, (parent, _, _, texts, _) in enumerate(nodes):
        depth[k] = depth[parent] + 1 if parent >= 0 else 0
        pieces[k] = [(at, 0, t) for at, t in texts]
    commas, n_p, n_img, links = [0] * size, [0] * size, [0] * size, [0] * size
    whole = [""] * size
    children: list[list[int]] = [[] for _ in range(size)]
    for k in range(size - 1, -1, -1):
        parent, tag, _, texts, _ = nodes[k]
        hidden = tag in RAW
        parts = [(at, t) for at, t in texts] if not hidden else []
        parts += [(c, whole[c]) for c in children[k]] if not hidden else []
        parts.sort(key=lambda x: x[0])
        inner = "".join(t if at not in children[k] or tag_inline(nodes[at][1]) else f" {t} " for at, t in parts)
        whole[k] = inner
        commas[k] = inner.count(",")
        n_p[k] += tag == "p"
        n_img[k] += tag == "img"
        if tag == "a":
            links[k] = len(" ".join(inner.split()))
        if parent >= 0:
            children[parent].append(k)
            n_p[parent] += n_p[k]
            n_img[parent] += n_img[k]
            links[parent] += links[k]
    rows = []
    for k, (parent, tag, attrs, texts, last) in enumerate(nodes):
        text = " ".join(whole[k].split())
        rows.append((k, parent, last, depth[k], tag, attrs, " ".join("".join(t for _, t in texts).split()), text, words_in(text), commas[k], n_p[k] - (tag == "p"), n_img[k] - (tag == "img"), links[k], len(text)))
    return rows


def tag_inline(tag: str) -> bool:
    return tag not in BLOCKS and tag not in ("li", "td", "th", "tr", "br", "dt", "dd", "figure", "figcaption")


def parse_nodes(pages: DataFrame, id_column: str, html_column: str) -> DataFrame:
    """(page_id, NODES): the elements of each page. Null and empty pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        names = [c.split()[0] for c in re.sub(r"<[^>]*>", "", NODES).split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                at, rows = [], []
                for k, value in enumerate(part.column(1)):
                    html = value.as_py()
                    if html:
                        made = node_rows(html)
                        rows += made
                        at += [k] * len(made)
                if rows:
                    columns = list(zip(*rows))
                    columns[5] = [list(a.items()) for a in columns[5]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["page_id", *names])

    kind = pages.schema[id_column].dataType.simpleString()
    return pages.select(id_column, html_column).mapInArrow(run, f"page_id {kind}, {NODES}")


def preprocess_html(html: Column) -> Column:
    """Raw pages before parsing: open shadow roots unwrapped, ``wbr`` dropped, script-less content of empty bodies taken
    out of ``noscript``."""
    shadow = F.regexp_replace(html, r"(?is)<template\b[^>]*\bshadowrootmode=[\"']?open[\"']?[^>]*>(.*?)</template>", "$1")
    plain = F.regexp_replace(shadow, r"(?i)</?wbr\s*/?>", "")
    only = plain.rlike(r"(?is)<body[^>]*>\s*(?:<script\b[^>]*>.*?</script>\s*|<noscript\b[^>]*>.*?</noscript>\s*)+</body>")
    return F.when(only, F.regexp_replace(plain, r"(?i)</?noscript\b[^>]*>", "")).otherwise(plain)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " "), r"\s+", " "))


#: Class words of content, in order of trust, and of what surrounds it.
CONTENT_SELECTORS = (
    ("id", "post"), ("class", "post-content"), ("class", "post-body"), ("class", "article-content"), ("id", "article-content"), ("class", "entry-content"), ("class", "content-article"), ("class", "post"), ("class", "markdown-body"),
    ("tag", "article"), ("role", "article"), ("tag", "main"), ("role", "main"), ("class", "article-body"), ("id", "content"), ("tag", "body"),
)
NOISE_TAGS = ("nav", "aside", "footer", "form", "button", "iframe", "dialog")
NOISE_WORDS = r"(?i)(?:^|[-_ ])(?:ad|ads|advert|banner|breadcrumb|comment-form|cookie|menu|newsletter|popup|promo|related|share|sidebar|social|sponsor|subscribe|toolbar|widget)(?:$|[-_ ])"
ACTIVE_TAGS = ("script", "style", "iframe", "object", "embed", "form", "input", "button", "textarea", "select", "link")


def attribute(name: str) -> Column:
    return F.coalesce(F.element_at("attrs", F.lit(name)), F.lit(""))


def has_class(name: str) -> Column:
    return F.array_contains(F.split(attribute("class"), r"\s+"), name)


def link_density() -> Column:
    return F.when(F.col("chars") > 0, F.least(F.col("link_chars") / F.col("chars"), F.lit(1.0))).otherwise(0.0)


def content_score() -> Column:
    """Words, paragraphs and commas for a node; images, and then links, against it; dates, bylines and content classes
    add to it."""
    date = F.col("text").rlike(r"(?i)(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2}|\d{1,2}(?:st|nd|rd|th)?\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec))")
    byline = F.col("text").rlike(r"\bBy\s+[A-Z]")
    classed = F.lower(attribute("class")).rlike("content|article|post")
    raw = F.col("words") + F.col("n_p") * 10 + F.col("commas") - F.col("n_img") / F.greatest(F.col("words"), F.lit(1)) * 3 + F.when(date, 10).otherwise(0) + F.when(byline, 10).otherwise(0) + F.when(classed, 15).otherwise(0)
    return raw * (1 - F.least(link_density(), F.lit(0.5)))


def candidates(nodes: DataFrame) -> DataFrame:
    """Nodes that an ordered list of selectors takes for content, with the score of each."""
    rank = F.lit(None).cast("int")
    for k, (kind, name) in reversed(list(enumerate(CONTENT_SELECTORS))):
        hit = {"tag": F.col("tag") == name, "class": has_class(name), "id": attribute("id") == name, "role": attribute("role") == name}[kind]
        rank = F.when(hit, k).otherwise(rank)
    return nodes.withColumn("selector", rank).where("selector is not null").withColumn("score", F.lit(float(len(CONTENT_SELECTORS))) * 40 - F.col("selector") * 40 + content_score())


def main_nodes(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, last, tag, words) of each page's content: the best candidate, then the deepest one within it that
    was selected more narrowly, has over 50 words and a quarter of its words. Pages without a candidate take the best
    block element. The best is a maximum over structs, with partial aggregation."""
    found = candidates(nodes)
    best = found.groupBy("page_id").agg(F.max(F.struct("score", (-F.col("pre")).alias("o"), "pre", "last", "tag", "words", "selector")).alias("b"))
    inner = found.alias("n").join(best, "page_id").where("n.pre > b.pre and n.last <= b.last and n.selector < b.selector and n.words > 50 and n.words >= 0.25 * b.words")
    deep = inner.groupBy("page_id").agg(F.max(F.struct("n.depth", (-F.col("n.pre")).alias("o"), F.col("n.pre").alias("pre"), F.col("n.last").alias("last"), F.col("n.tag").alias("tag"), F.col("n.words").alias("words"))).alias("d"), F.count("*").alias("several"))
    chosen = best.join(deep, "page_id", "left").select("page_id", *[F.coalesce(F.when(F.col("several") == 1, F.col(f"d.{c}")), F.col(f"b.{c}")).alias(c) for c in ("pre", "last", "tag", "words")])
    blocks = nodes.join(best.select("page_id"), "page_id", "left_anti").where(F.col("tag").isin("div", "section", "article", "main", "p", "pre", "ul", "blockquote"))
    scored = blocks.groupBy("page_id").agg(F.max(F.struct(content_score().alias("s"), (-F.col("pre")).alias("o"), "pre", "last", "tag", "words")).alias("b")).select("page_id", "b.pre", "b.last", "b.tag", "b.words")
    return chosen.unionByName(scored)


def readme_nodes(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, last) of the read-me text of a repository's page."""
    box = nodes.where(attribute("id").rlike("(?i)^readme$") | (attribute("data-testid") == "readme")).select("page_id", F.col("pre").alias("_a"), F.col("last").alias("_b"))
    texts = nodes.where((F.col("tag") == "article") & has_class("markdown-body")).join(box, "page_id", "left").withColumn("_in", F.coalesce(F.col("pre").between(F.col("_a"), F.col("_b")), F.lit(False)))
    return texts.groupBy("page_id").agg(F.min(F.struct((~F.col("_in")).alias("o"), "pre", "last")).alias("r")).select("page_id", "r.pre", "r.last")


def hidden_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes hidden by style, class or attribute; formulas keep theirs."""
    style = F.regexp_replace(F.lower(attribute("style")), r"\s", "")
    hidden = style.rlike("display:none|visibility:hidden|opacity:0(?:;|$)") | has_class("hidden") | has_class("invisible") | F.map_contains_key("attrs", F.lit("hidden"))
    return nodes.where(hidden & ~F.lower(attribute("class")).rlike("katex|math|mjx"))


def small_images(nodes: DataFrame) -> DataFrame:
    """Images of which both sides are known to be under 33 pixels."""
    side = lambda name: F.regexp_extract(attribute(name), r"^(\d+)", 1).try_cast("int")
    return nodes.where(F.col("tag").isin("img", "svg") & (side("width") < 33) & (side("height") < 33))


def noise_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose element or class says that they are no content, and short blocks made of links."""
    named = F.col("tag").isin(*NOISE_TAGS) | attribute("class").rlike(NOISE_WORDS) | attribute("id").rlike(NOISE_WORDS) | attribute("role").isin("navigation", "complementary", "contentinfo", "banner")
    linked = F.col("tag").isin("div", "section", "ul") & (F.col("words").between(1, 60)) & (link_density() > 0.8) & (F.col("n_p") < 2)
    return nodes.where((named & ~F.col("tag").isin("body", "html", "article", "main")) | linked)


def active_nodes(nodes: DataFrame) -> DataFrame:
    """Elements that act: scripts, forms, frames. Check boxes stay."""
    return nodes.where(F.col("tag").isin(*ACTIVE_TAGS) & ~((F.col("tag") == "input") & (F.lower(attribute("type")) == "checkbox")))


def without_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes that are not in the subtree of any of ``roots``. The intervals of a page are one small array, joined
    by page."""
    spans = roots.groupBy("page_id").agg(F.collect_list(F.struct("pre", "last")).alias("_spans"))
    joined = nodes.join(spans, "page_id", "left")
    inside = F.exists("_spans", lambda s: (F.col("pre") >= s["pre"]) & (F.col("pre") <= s["last"]))
    return joined.where(F.col("_spans").isNull() | ~inside).drop("_spans")


def text_of(nodes: DataFrame) -> DataFrame:
    """(page_id, text): the own texts of the nodes in document order."""
    return nodes.where("own_text <> ''").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "own_text"))), lambda x: x["own_text"]), " ").alias("text"))


def main_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, text) of each page's content without hidden, active and noise subtrees."""
    clean = without_subtrees(nodes, hidden_nodes(nodes).select("page_id", "pre", "last").unionByName(noise_nodes(nodes).select("page_id", "pre", "last")).unionByName(active_nodes(nodes).select("page_id", "pre", "last")))
    root = main_nodes(nodes).select("page_id", F.col("pre").alias("_a"), F.col("last").alias("_b"))
    return text_of(clean.join(root, "page_id").where("pre between _a and _b"))


def tag_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tag").agg(F.count("*").alias("n"))


def heading_outline(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, level, heading) of headings that show text."""
    return nodes.where(F.col("tag").rlike("^h[1-6]$") & (F.col("text") != "")).select("page_id", "pre", F.substring("tag", 2, 1).try_cast("int").alias("level"), F.col("text").alias("heading"))


def link_relation(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, href, label) of links; script links are left out."""
    return nodes.where((F.col("tag") == "a") & (attribute("href") != "") & ~F.lower(attribute("href")).startswith("javascript:")).select("page_id", "pre", attribute("href").alias("href"), F.col("text").alias("label"))


def best_source(srcset: Column) -> Column:
    """The picture of the greatest width or density of a source set; the first of equals."""
    parts = F.transform(F.split(srcset, r",\s+|,(?=https?:)"), lambda p: F.trim(p))
    sized = F.transform(F.filter(parts, lambda p: p != ""), lambda p, i: F.struct(F.coalesce(F.nullif(F.regexp_extract(p, r"\s([\d.]+)[wx]$", 1), F.lit("")).try_cast("double"), F.lit(1.0)).alias("size"), (-i).alias("o"), F.regexp_extract(p, r"^(\S+)", 1).alias("url")))
    return F.array_max(sized)["url"]
