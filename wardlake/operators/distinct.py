"""Exact distinct counts that merge: bitmaps of numbered keys.

Every key has a small number of its own. The numbers that occur in a cell (a state and month, say) are
the bits of a bitmap, cut into buckets of 32,768 bits. Cells merge by OR, so the distinct count
over any set of cells is read from their bitmaps and never from the rows they were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.operators.ranges import SortedRanges


def numbered(known: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Numbers (``key``, ``number``) for those keys that ``known`` lacks, following its largest one.

    Sorted into ranges once, so that numbers have no gaps and no task sees all keys.
    """
    new = keys.select(key).where(F.col(key).isNotNull()).distinct().join(known, key, "left_anti")
    last = known.agg(F.max("number")).first()[0]
    ranges = SortedRanges(new, [F.col(key)])
    rows = ranges.stretch([(0, ranges.total)])
    return rows.select(key, (F.col("_upto") + F.lit(-1 if last is None else last)).alias("number"))


def bitmaps(cells: DataFrame, by: list[str], number: str = "number") -> DataFrame:
    """Bitmaps (``bucket``, ``bits``) of the numbers in each cell; combined before the shuffle."""
    return cells.groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def distinct_count(maps: DataFrame, by: list[str], name: str) -> DataFrame:
    """Distinct keys per value of ``by`` (one row over all for none) from bitmaps of finer cells."""
    merged = maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))
