"""Deterministic orderings, top-N and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators.ranges import SortedRanges


def order(*keys: str) -> list[Column]:
    """Sort columns from names; a leading minus means descending. NULLs come last either way."""
    return [
        F.col(key[1:]).desc_nulls_last() if key.startswith("-") else F.col(key).asc_nulls_last()
        for key in keys
    ]


def top_n(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """First ``n`` rows by the keys; every task keeps ``n`` rows at most."""
    return df.orderBy(*order(*keys)).limit(n)


def paginate(df: DataFrame, page: int, size: int, *keys: str) -> DataFrame:
    """Page ``page`` (from 1) as a lazy frame, for pages near the front.

    The work grows with ``page * size`` rows, not with the table. ``Pager``
    serves pages at any depth.
    """
    return df.orderBy(*order(*keys)).offset((page - 1) * size).limit(size)


class Pager:
    """Any page of a frame of any size after one distributed sort.

    A page reads the folders of the one or two ranges it lies in, and nothing else.
    """

    def __init__(self, df: DataFrame, size: int, *keys: str):
        self._size = size
        self._ranges = SortedRanges(df, order(*keys))
        self.total = self._ranges.total
        self.pages = max(1, -(-self.total // size))

    def page(self, number: int) -> DataFrame:
        first = (number - 1) * self._size
        last = first + self._size
        rows = self._ranges.stretch([(first, last)])
        return (
            rows.where((F.col("_upto") > first) & (F.col("_upto") <= last))
            .orderBy("_upto")
            .select(*self._ranges.columns)
        )
