"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from wardlake.session import delete_scratch, scratch_path, shuffles_cleaned

_SCOPES: list[list[str]] = []  # paths made in each open ``scope``


def new_path(spark: SparkSession, purpose: str) -> str:
    """A path in the shared folder that nothing has used yet; an open ``scope`` knows of it."""
    path = scratch_path(spark, purpose)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


@contextmanager
def scope() -> Iterator[list[str]]:
    """Collects the paths of all tables that are stored in the block."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def release(spark: SparkSession, paths: list[str], needed: DataFrame) -> list[str]:
    """Delete the given tables but for those that ``needed`` reads; returns the paths that are left."""
    read = {urlparse(file).path.rsplit("/", 1)[0] for file in needed.inputFiles()}
    left = []
    for path in paths:
        plain = urlparse(path).path
        if any(folder == plain or folder.startswith(f"{plain}/") for folder in read):
            left.append(path)
        else:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    return left


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage at files that outlive executors, and lets Spark plan with the true size:
    a small table is broadcast only where it is known to be below the session's threshold.
    """
    spark = df.sparkSession
    path = new_path(spark, purpose)
    with shuffles_cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that later stored ones have replaced; frames made from them cannot be run again."""
    for table in tables:
        delete_scratch(table)
