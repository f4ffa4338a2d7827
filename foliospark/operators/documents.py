"""Documents as relations of pages, paragraphs and lines, and the operators on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import boundary_key, collapse, is_garbled, let

#: Fixed values of running lines: lines at either end of a page, pages from which a document counts, pages and share of
#: the pages on which a line must stand.
EDGE_LINES = 2
DOCUMENT_PAGES = 4
LEAST_PAGES = 3
LEAST_SHARE = 0.6
#: Paragraphs shorter than this are never taken for copies.
PARAGRAPH = 100
MARKER = r"<!-- (?:Page|Slide) (?:number: ?)?\d+ -->"


def paragraphs(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, paragraph): the parts between empty lines that are not blank."""
    return texts.where(F.col(text_column).isNotNull()).select(id_column, F.posexplode(F.split(text_column, "\n\n+")).alias("pos", "paragraph")).where(F.trim(F.regexp_replace("paragraph", r"\s+", " ")) != "")


def unique_paragraphs(texts: DataFrame, id_column: str, text_column: str, least: int = PARAGRAPH) -> DataFrame:
    """(id, text) with the second and later copies of a long paragraph left out of each document. A copy has the same
    words after blanks are collapsed; short paragraphs stay. The row's own array is sorted by words, neighbours are
    compared and the first ones put back into order: no shuffle, and n log n in a document's paragraphs."""
    keyed = F.array_sort(F.transform(F.split(text_column, "\n\n+"), lambda p, i: F.struct(collapse(p).alias("key"), i.alias("i"), p.alias("p"))))
    first = lambda s: F.zip_with(s, F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda x: x["key"])), lambda x, k: F.when(x.isNotNull() & (x["key"] != "") & ((F.char_length(x["key"]) < least) | k.isNull() | (x["key"] != k)), F.struct(x["i"].alias("i"), x["p"].alias("p"))))
    kept = let(keyed, lambda s: F.transform(F.array_sort(F.filter(first(s), lambda x: x.isNotNull())), lambda x: x["p"]))
    return texts.where(F.col(text_column).isNotNull()).select(id_column, F.array_join(kept, "\n\n").alias("text"))


def marked_pages(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, page_no, text): the parts of a text after its page or slide markers. What stands before the first is left
    out, texts without markers have no pages."""
    cut = let(F.split(text_column, MARKER, -1), lambda p: F.slice(p, F.lit(2), F.size(p)))
    numbers = F.regexp_extract_all(text_column, F.lit(r"<!-- (?:Page|Slide) (?:number: ?)?(\d+) -->"), 1)
    return texts.where(F.col(text_column).rlike(MARKER)).select(id_column, F.explode(F.arrays_zip(numbers.alias("n"), cut.alias("t"))).alias("x")).select(id_column, F.col("x.n").try_cast("int").alias("page_no"), F.col("x.t").alias("text"))


def is_protected(line: Column) -> Column:
    """Headings and table rows."""
    return F.ltrim(F.regexp_replace(line, "^\t+", "")).rlike(r"^[#|]")


def _edge_lines(text: Column) -> Column:
    """array of (at, key, top) of the first and last EDGE_LINES lines that are not blank or protected."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("at"), x.alias("line")))
    full = F.filter(lines, lambda x: collapse(x["line"]) != "")
    ends = F.array_distinct(F.concat(F.slice(full, 1, EDGE_LINES), F.when(F.size(full) > EDGE_LINES, F.slice(full, -EDGE_LINES, EDGE_LINES)).otherwise(F.slice(full, 1, EDGE_LINES))))
    return F.transform(F.filter(ends, lambda x: ~is_protected(x["line"])), lambda x: F.struct(x["at"].alias("at"), boundary_key(x["line"]).alias("key")))


def running_keys(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, key, on_pages) of the lines at the edges that stand on enough of a document's pages."""
    edges = pages.select(document, page, F.explode(_edge_lines(F.col(text))).alias("e")).select(document, page, "e.key").distinct()
    counted = edges.groupBy(document, "key").agg(F.count("*").alias("on_pages"))
    sizes = pages.groupBy(document).agg(F.count("*").alias("pages")).where(F.col("pages") >= DOCUMENT_PAGES)
    return counted.join(sizes, document).where((F.col("on_pages") >= LEAST_PAGES) & (F.col("on_pages") >= F.ceil(F.col("pages") * LEAST_SHARE))).select(document, "key", "on_pages")


def strip_running(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, page, text) without the running lines at the edges. The keys of a document join its pages as one
    small array: a running line stands on 60 % of the pages, so there are seven at most."""
    keys = running_keys(pages, document, page, text).groupBy(document).agg(F.collect_set("key").alias("keys"))
    drop = F.transform(F.filter(_edge_lines(F.col(text)), lambda e: F.array_contains("keys", e["key"])), lambda e: e["at"])
    kept = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(~F.array_contains(drop, i), x)), lambda x: x.isNotNull())
    return pages.join(keys, document, "left").select(document, page, F.when(F.col("keys").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("text"))


def page_advice(pages: DataFrame, page_key: str, text: str) -> DataFrame:
    """(page_key, advice): pages with next to no text, and garbled ones."""
    size = F.char_length(collapse(F.coalesce(text, F.lit(""))))
    return pages.select(page_key, F.when(size < 50, "scanned").when(is_garbled(F.col(text)), "garbled").alias("advice")).where("advice is not null")


def scanned_documents(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """(document, mean_length, scanned): scanned when the first three pages have under 100 characters on average. The
    least pages are found by aggregation, one after another."""
    lengths = pages.select(document, F.col(page).alias("p"), F.char_length(F.coalesce(text, F.lit(""))).alias("n")).groupBy(document, "p").agg(F.min("n").alias("n"))
    starts = lengths.groupBy(document).agg(F.min("p").alias("p1"))
    second = lengths.join(starts, document).where("p > p1").groupBy(document).agg(F.min("p").alias("p2"))
    third = lengths.join(second, document).where("p > p2").groupBy(document).agg(F.min("p").alias("p3"))
    limit = starts.join(second, document, "left").join(third, document, "left").select(document, F.coalesce("p3", "p2", "p1").alias("upto"))
    return lengths.join(limit, document).where("p <= upto").groupBy(document).agg(F.round(F.avg("n"), 6).alias("mean_length")).select(document, "mean_length", (F.col("mean_length") < 100).alias("scanned"))


def hidden_spans(spans: DataFrame) -> DataFrame:
    """Spans that a reader does not see: transparent, tiny, nearly white, or off the page."""
    red, green, blue = F.shiftright("color", 16).bitwiseAND(255), F.shiftright("color", 8).bitwiseAND(255), F.col("color").bitwiseAND(255)
    light = (red * 0.299 + green * 0.587 + blue * 0.114) / 255
    outside = (F.col("x1") <= F.col("left")) | (F.col("x0") >= F.col("right")) | (F.col("y1") <= F.col("top")) | (F.col("y0") >= F.col("bottom"))
    return spans.where((F.col("alpha") == 0) | (F.col("size") < 2) | (light > 0.95) | outside)


def code_flags(lines: Column) -> Column:
    """array of whether each line belongs to a fenced code block. Only the lines that may open or close one are folded, to
    the places where blocks begin and end; the stretches between these are then written out."""
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_extract(x, r"^(`{3,}|~{3,})", 1).alias("mark"))), lambda m: m["mark"] != "")
    start = F.struct(F.lit("").alias("open"), F.array(F.lit(0)).alias("cuts"))

    def step(acc: Column, m: Column) -> Column:
        opens = acc["open"] == ""
        closes = ~opens & (F.substring(m["mark"], 1, 1) == F.substring(acc["open"], 1, 1)) & (F.length(m["mark"]) >= F.length(acc["open"]))
        cuts = F.when(opens, F.concat(acc["cuts"], F.array(m["at"]))).when(closes, F.concat(acc["cuts"], F.array(m["at"] + 1))).otherwise(acc["cuts"])
        return F.struct(F.when(opens, m["mark"]).when(closes, "").otherwise(acc["open"]).alias("open"), cuts.alias("cuts"))

    cuts = F.aggregate(marks, start, step, lambda acc: F.concat(acc["cuts"], F.array(F.size(lines))))
    # stretches alternate: text, code, text, ...
    return let(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(0), F.size(c) - 2), lambda k: F.array_repeat(k % 2 == 1, F.get(c, k + 1) - F.get(c, k)))))


def line_relation(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, line_no, line, in_code): every line, with whether it stands in a fenced code block. A block ends at a mark of
    the same sign and at least its length, or with the text."""
    pairs = let(F.split(text_column, "\n", -1), lambda lines: F.arrays_zip(lines.alias("line"), code_flags(lines).alias("in_code")))
    return texts.where(F.col(text_column).isNotNull()).select(id_column, F.posexplode(pairs).alias("at", "x")).select(id_column, (F.col("at") + 1).alias("line_no"), F.col("x")[F.lit("line")].alias("line"), F.col("x")[F.lit("in_code")].alias("in_code"))


def headings(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, line_no, level, heading): hash headings outside code, one row each."""
    return line_relation(texts, id_column, text_column).where(~F.col("in_code") & F.col("line").rlike(r"^#{1,6}\s+\S")).select(
        id_column, "line_no", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1), r"\s+#+\s*$", "")).alias("heading")
    )


def links(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, label, target) of inline links, images left out."""
    found = F.regexp_extract_all(text_column, F.lit(r"(?<!!)\[([^\[\]]*)\]\(([^()\s]+)\)"), 0)
    return texts.where(F.col(text_column).isNotNull()).select(id_column, F.posexplode(found).alias("pos", "x")).select(id_column, "pos", F.regexp_extract("x", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("x", r"\(([^)]*)\)$", 1).alias("target"))


def repeated_tail(text: Column, least: int = 6) -> Column:
    """How many of a text's last non-empty lines are the same line, when at least ``least`` are; else 0."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    back = F.reverse(lines)
    same = F.aggregate(back, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & (x == F.get(back, 0)), 1).otherwise(0)).alias("n"), (a["on"] & (x == F.get(back, 0))).alias("on")))["n"]
    return F.when(same >= least, same).otherwise(0)
