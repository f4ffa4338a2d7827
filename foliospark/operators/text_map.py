"""Functions on single texts as columns, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown_text as md
from .markdown_blocks import spaced, without_footers


def map_text(df: DataFrame, id_column: str, text_column: str, use: Callable[[str], str | None], name: str = "text") -> DataFrame:
    """(id, name): ``use`` of each text; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if v is None else use(v) for v in batch.column(1).to_pylist()], pa.string())], names=[id_column, name])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {name} string")


def _mended(text: str) -> str:
    return md.mend_images(md.mend_links(text))


def normalized_markdown(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Links, images, slide footers and spacing mended, in this order; the last two in the JVM."""
    mended = map_text(df, id_column, text_column, _mended)
    return mended.select(id_column, spaced(without_footers(F.col("text"))).alias("text"))


def _kept(text: str) -> str:
    held, marks = md.protect(text)
    return md.unprotect(held, marks)


def protected_round_trip(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Structural marks taken out and put back: what a later stage would get when it changes nothing."""
    return map_text(df, id_column, text_column, _kept)
