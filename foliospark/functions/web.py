"""Column functions on hosts and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(domain: Column) -> Column:
    """A domain without case, leading ``www.`` and port; null when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(domain)), r":\d*$", ""), r"^www\.", "")
    return F.when(bare != "", bare)
