"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage like ``checkpoint()`` but keeps its columns, so later reads prune
them and any lost executor can be replaced. Nothing written there outlives the session, and ``scratch`` removes it
earlier.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only where none is set and
    the master is local (tests)."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    spark.conf.set(SETTING, made)
    return made


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the cluster's storage layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends or the scratch it was made in closes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, at = file_system(spark, path)
    files.deleteOnExit(at)
    if _open:
        _open[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as parquet into the shared folder and reads it back: a cut in the lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes all tables that were materialised inside when it closes: use the results before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            files, at = file_system(spark, path)
            files.delete(at, True)
