"""Images of documents: extraction of embedded bytes, duplicates, size filters, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import asset_names, data_uris

LEAST_WIDTH, LEAST_HEIGHT, LEAST_AREA = 50, 50, 5000


def embedded(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, pos, mime, size, md5) of the images that a text carries."""
    each = texts.where(F.col(text_column).isNotNull()).select(id_column, F.posexplode(data_uris(F.col(text_column))).alias("pos", "x"))
    return each.select(id_column, "pos", F.col("x.mime").alias("mime"), F.octet_length("x.data").alias("size"), F.md5("x.data").alias("md5"))


def first_of_each(images: DataFrame, document: str, pos: str, digest: str) -> DataFrame:
    """The first image of each content in a document; found by partial aggregation."""
    firsts = images.groupBy(document, digest).agg(F.min(pos).alias(pos))
    return images.join(firsts, [document, digest, pos], "left_semi")


def too_small(width: Column, height: Column) -> Column:
    return (width < LEAST_WIDTH) | (height < LEAST_HEIGHT) | (width * height < LEAST_AREA)


def references(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return texts.where(F.col(text_column).isNotNull()).select(id_column, F.posexplode(asset_names(F.col(text_column))).alias("pos", "name"))


def missing_references(used: DataFrame, stored: DataFrame) -> DataFrame:
    """References to images that are not in the store."""
    return used.join(stored.select("name").distinct(), "name", "left_anti")


def content_address(data: Column, name: Column) -> Column:
    """The name of a blob: 16 hex digits of its hash, and the suffix of its file."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.concat(F.substring(F.sha2(data, 256), 1, 16), suffix)


def heif_brand(data: Column) -> Column:
    """Whether bytes begin with the box of an HEIF or AVIF file."""
    brand = F.decode(F.substring(data, 5, 8), "ISO-8859-1")
    return brand.rlike("^ftyp(heic|heix|hevc|heim|heis|mif1|msf1|avif|avis)$")
