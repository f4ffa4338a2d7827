"""Column functions on paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Media types by suffix; the first suffix of a type is the one it gets.
MEDIA_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "tiff": "image/tiff", "tif": "image/tiff", "avif": "image/avif", "heic": "image/heic",
    "html": "text/html", "htm": "text/html", "md": "text/markdown", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "pdf": "application/pdf", "eml": "message/rfc822", "ipynb": "application/x-ipynb+json",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(known, suffix(path)), F.lit("application/octet-stream"))


def suffix_of_type(kind: Column) -> Column:
    """The suffix of a media type, without its parameters; bin for others."""
    first: dict[str, str] = {}
    for name, media in MEDIA_TYPES.items():
        first.setdefault(media, name)
    known = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(F.trim(F.split_part(kind, F.lit(";"), F.lit(1))))), F.lit("bin"))


def normal_path(path: Column) -> Column:
    """A path without empty, ``.`` and ``..`` segments; ``..`` never leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def within(path: Column, base: Column) -> Column:
    """Whether a path stays in a folder once its segments are resolved."""
    inner, outer = normal_path(path), normal_path(base)
    return (inner == outer) | inner.startswith(F.concat(outer, F.when(F.endswith(outer, F.lit("/")), "").otherwise("/")))


def output_name(name: Column) -> Column:
    """The whole input name with ``.md`` behind it, so that inputs of different formats never meet."""
    return F.concat(F.regexp_extract(name, r"([^/\\]+)$", 1), F.lit(".md"))


def versioned(name: Column, version: Column) -> Column:
    """A name with ``.vN`` before its suffix from version 2 on; ``.llm.md`` counts as one suffix."""
    tail = F.regexp_extract(name, r"((?:\.llm)?\.[^./]+)$", 1)
    return F.when(version < 2, name).otherwise(F.concat(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(tail)), F.lit(".v"), version.cast("string"), tail))
