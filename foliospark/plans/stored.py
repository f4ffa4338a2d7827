"""Tables that grow by deltas and outlive a run, as numbered folders beside each other.

``base-000007-...`` replaces all before it, ``delta-000008-...`` adds to it. A folder counts once its commit file is there,
so a writer that dies leaves the table as it was, and readers of an older base are not disturbed: it is removed only when
the base after the next one is written.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .shared import file_system

#: Deltas from which a table is written anew as one base.
MOST_DELTAS = 8
_NAME = re.compile(r"(base|delta)-(\d+)-\w+")


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[tuple[int, str, str]]:
        """(number, kind, path) of the complete folders, in order. Only a missing table is empty; errors are raised."""
        files, root = file_system(self.spark, self.path)
        if not files.exists(root):
            return []
        found = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if (m := _NAME.fullmatch(name)) and files.exists(file_system(self.spark, f"{self.path}/{name}/_SUCCESS")[1]):
                found.append((int(m.group(2)), m.group(1), f"{self.path}/{name}"))
        return sorted(found)

    def _live(self) -> list[tuple[int, str, str]]:
        parts = self._parts()
        last = max((k for k, p in enumerate(parts) if p[1] == "base"), default=0)
        return parts[last:]

    def read(self, schema: StructType | str | None = None) -> DataFrame | None:
        """The table, or None when none was written."""
        live = [p for _, _, p in self._live()]
        if not live:
            return None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*live)

    def deltas(self) -> int:
        return sum(kind == "delta" for _, kind, _ in self._live())

    def _write(self, kind: str, df: DataFrame) -> str:
        number = max((n for n, _, _ in self._parts()), default=0) + 1
        path = f"{self.path}/{kind}-{number:06d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path

    def append(self, df: DataFrame) -> DataFrame:
        """Adds a delta and gives the rows as written."""
        return self.spark.read.schema(df.schema).parquet(self._write("delta", df))

    def replace(self, df: DataFrame) -> DataFrame:
        """Writes a new base, which may be made from the present one, and removes what no reader of the present one needs."""
        old = self._parts()
        bases = [n for n, kind, _ in old if kind == "base"]
        made = self.spark.read.schema(df.schema).parquet(self._write("base", df))
        for number, _, path in old:
            if bases and number < bases[-1]:
                files, at = file_system(self.spark, path)
                files.delete(at, True)
        return made
