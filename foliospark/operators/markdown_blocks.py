"""Blocks and lines of Markdown as arrays of a row: spacing, slide footers, repeated blocks, and what two texts share.
Lines are cleaned and counted in the JVM; only containment and alignment run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markdown_text import first_tellings, score_blocks
from ..functions.text import let
from .documents import code_flags

#: Lines that get blank lines around them.
SPACED = r"^(?:#{1,6}(?:\s|$)|<!--\s*Slide\s+(?:number:\s*)?\d+\s*-->)"
#: Fixed values of slide footers: the mark before a page, lines looked at from its end, their length, signs they never begin
#: with, pages that must have one, and the share of these on which a footer stands.
PAGE_MARK = r"<!-- (?:Page|Slide) (?:number: ?)?\d+ -->"
FOOTER_LINES, FOOTER_CHARS, FOOTER_SIGNS, FOOTER_PAGES, FOOTER_SHARE = 4, 30, r"^[#!\[\-*]", 3, 0.5
#: Fixed values of repeated blocks: what a line of prose never begins with, and what is taken off before lines are compared.
BLOCK_SIGNS = r"^(?:#|!|\[|\||-|\*|>|```|<!--)"
BLOCK_NOISE = (
    r"^[A-Za-z\s]+@\w+\s+",
    r"^@\w+\s*",
    r"\d+:\d+\s*(AM|PM|am|pm)?\s*·?\s*",
    r"(?i)\d+\s*(replies|reposts|likes|views|bookmarks)[,\s]*",
)
#: Fixed values of scoring: what does not count when texts are compared, and the least alignment of a block.
SCORE_NOISE = (r"```[^\n]*", r"[#*_`>|]")
ALIGNED = 70.0


def _ends_stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def spaced(text: Column) -> Column:
    """Headings and slide marks outside code with one blank line on either side, no blanks at line ends, at most one blank
    line in a row, one line end at the close: each such line gets line ends around it, and rows of line ends shrink."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\s+$", ""))
    wide = let(lines, lambda ls: F.array_join(F.zip_with(ls, code_flags(ls), lambda x, code: F.when(~code & x.rlike(SPACED), F.concat(F.lit("\n"), x, F.lit("\n"))).otherwise(x)), "\n"))
    return F.concat(F.regexp_replace(F.regexp_replace(wide, "\n{3,}", "\n\n"), r"^\n+|\n+$", ""), F.lit("\n"))


def _page_ends(text: Column) -> Column:
    """For each page behind a mark, the short lines among its last ones; pages without such lines are left out."""
    def short(page: Column) -> Column:
        full = F.filter(F.transform(F.split(page, "\n", -1), _ends_stripped), lambda x: x != "")
        return let(full, lambda f: F.when(F.size(f) >= 2, F.filter(F.slice(F.reverse(f), 1, FOOTER_LINES), lambda x: (F.char_length(x) < FOOTER_CHARS) & ~x.rlike(FOOTER_SIGNS))).otherwise(F.array().cast("array<string>")))

    return F.filter(F.transform(let(F.split(text, PAGE_MARK, -1), lambda p: F.slice(p, F.lit(2), F.size(p))), short), lambda e: F.size(e) > 0)


def _footers(text: Column) -> Column:
    """The lines that end enough pages. In the sorted lines such a line is a run, and a run of that length meets one of
    the places that lie as far apart, so at most nine lines are counted."""
    def common(ends: Column) -> Column:
        least = F.ceil(F.size(ends) * FOOTER_SHARE).cast("int")
        found = let(F.array_sort(F.flatten(ends)), lambda every: F.filter(
            F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(every) - 1, least), lambda k: F.get(every, k))),
            lambda x: ~x.rlike(r"^\d+$") & (F.size(F.filter(every, lambda y: y == x)) >= least),
        ))
        return F.when(F.size(ends) >= FOOTER_PAGES, found).otherwise(F.array().cast("array<string>"))

    return let(_page_ends(text), common)


def without_footers(text: Column) -> Column:
    """Without the lines that end at least half of three or more pages, and page numbers in the two lines below one."""
    def strip(footers: Column) -> Column:
        lines = F.split(text, "\n", -1)
        known = lambda x: F.coalesce(F.array_contains(footers, x), F.lit(False))
        kept = let(F.transform(lines, _ends_stripped), lambda bare: F.filter(
            F.transform(lines, lambda x, i: F.when(~(known(F.get(bare, i)) | (F.get(bare, i).rlike(r"^\d+$") & (known(F.get(bare, i - 1)) | known(F.get(bare, i - 2))))), x)), lambda x: x.isNotNull()
        ))
        return F.when(F.size(footers) == 0, text).otherwise(F.array_join(kept, "\n"))

    return F.when(text.rlike(PAGE_MARK), let(_footers(text), strip)).otherwise(text)


def _telling(line: Column, least: int) -> Column:
    """What a long line of prose says, for comparison; null for all other lines."""
    bare = _ends_stripped(line)
    said = bare
    for pattern in BLOCK_NOISE:
        said = F.regexp_replace(said, pattern, "")
    said = _ends_stripped(F.regexp_replace(said, r"\s+", " "))
    return F.when((F.char_length(bare) >= least) & ~bare.rlike(BLOCK_SIGNS), let(said, lambda s: F.when(F.char_length(s) >= least, s)))


def unrepeated_blocks(texts: DataFrame, id_column: str, text_column: str, least: int = 50) -> DataFrame:
    """(id, text) without long lines of prose that stand in, or hold, one that was kept before; names, times and counters
    do not matter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if lines is None else "\n".join(x for x, new in zip(lines, first_tellings(said, least)) if new) for lines, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[id_column, "text"])

    lines = F.split(text_column, "\n", -1)
    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, lines.alias("_lines"), F.transform(lines, lambda x: _telling(x, least)).alias("_said")).mapInArrow(run, f"`{id_column}` {kind}, text string")


def comparable(text: Column) -> Column:
    """A text without code fences' marks, emphasis, headings' and tables' signs, blanks collapsed, in lower case."""
    for pattern in SCORE_NOISE:
        text = F.regexp_replace(text, pattern, "")
    return F.lower(_ends_stripped(F.regexp_replace(text, r"\s+", " ")))


def rendering_scores(texts: DataFrame, id_column: str, expected: str, produced: str) -> DataFrame:
    """(id, score) of how well ``produced`` renders ``expected``, 0 to 100: four fifths by its blocks, weighed by length,
    one fifth by their order. A null counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [score_blocks(a, b, ALIGNED) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=[id_column, "score"])

    blocks = F.filter(F.transform(F.split(F.coalesce(F.col(expected), F.lit("")), r"\n\s*\n", -1), comparable), lambda b: b != "")
    kind = texts.schema[id_column].dataType.simpleString()
    return texts.select(id_column, blocks.alias("_blocks"), comparable(F.coalesce(F.col(produced), F.lit(""))).alias("_text")).mapInArrow(run, f"`{id_column}` {kind}, score double")
