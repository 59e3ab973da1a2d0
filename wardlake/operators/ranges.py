"""Rows kept in sorted ranges, of which any stretch can be read by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.session import scratch_path

PART = "_part"


class SortedRanges:
    """A frame after one distributed sort, one folder per range in the shared folder.

    The driver holds one total per range (``weight`` summed, by default the rows). ``stretch``
    reads only the folders of the ranges that it touches.
    """

    def __init__(self, df: DataFrame, keys: list[Column], weight: Column | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        self._keys = keys
        self._weight = F.lit(1) if weight is None else weight
        path = scratch_path(spark, "ranges")
        ranged = df.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id())
        ranged.write.partitionBy(PART).parquet(path)
        self.rows = spark.read.schema(ranged.schema).parquet(path)
        totals = self.rows.groupBy(PART).agg(F.sum(self._weight).alias("total")).orderBy(PART)
        self._starts, self.total = [], 0
        for part, total in totals.collect():
            self._starts.append((part, self.total, total))
            self.total += total

    def stretch(self, pieces: list[tuple[int, int]]) -> DataFrame:
        """Rows of the ranges that touch any of the places ``first .. last - 1``.

        ``_upto`` is the running total up to and with each row, over the whole frame.
        """
        touched = [
            (part, start) for part, start, total in self._starts
            if any(start < last and start + total > first for first, last in pieces)
        ]
        begin = F.lit(None).cast("long")
        for part, start in touched:
            begin = F.when(F.col(PART) == part, F.lit(start)).otherwise(begin)
        within = Window.partitionBy(PART).orderBy(*self._keys)
        read = self.rows.where(F.col(PART).isin([part for part, _ in touched] or [-1]))
        running = F.sum(self._weight).over(within.rowsBetween(Window.unboundedPreceding, 0))
        return read.withColumn("_upto", begin + running)
