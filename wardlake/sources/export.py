"""Results as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.operators.ranking import order


def export_csv(df: DataFrame, path: str) -> None:
    """Write a result with a header line; each task writes its own part file."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def export_ordered(df: DataFrame, path: str, *keys: str) -> None:
    """Write a result in the order it is shown, by ``keys`` as in ``ranking.order``.

    The part files, joined in the order of their names, are one CSV file: the first has the header and
    nothing else, each further one has the next range of the order. Rows are sorted in ranges, so
    no task holds the result; only rows with equal keys have to meet.
    """
    quoted = F.to_csv(F.struct(*(F.lit(name) for name in df.columns)), {"quote": '"'})
    header = df.sparkSession.range(1, numPartitions=1).select(quoted.alias("line"))
    ordered = df.orderBy(*order(*keys))
    # A union keeps the partitions of its sides one after the other, and a part file is named by its partition.
    lines = ordered.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    header.unionByName(lines).write.mode("errorifexists").text(path)
