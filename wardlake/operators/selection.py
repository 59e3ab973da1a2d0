"""Filters a dashboard user can set, as columns instead of query text."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_or_all(name: str, values: list[str] | None) -> Column:
    """Membership test; an empty or missing list means every row."""
    return F.col(name).isin(list(values)) if values else F.lit(True)


def _next_month(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


@dataclass(frozen=True)
class Selection:
    """States, facilities and months to keep; the defaults keep everything.

    ``start`` and ``end`` are compared with the first day of each month. A
    single date selects one month: give it as ``start`` through ``one_month``.
    """

    states: list[str] | None = None
    ccns: list[str] | None = None
    start: date | None = None
    end: date | None = None

    @classmethod
    def one_month(cls, month: date, **others) -> Selection:
        return cls(start=month, end=month, **others)

    def keys(self) -> Column:
        kept = in_or_all("state", self.states)
        return kept & in_or_all("ccn", self.ccns) if self.ccns else kept

    def month_between(self, name: str = "month") -> Column:
        """Test on a finished view's month column."""
        month = F.col(name).cast("date")
        kept = F.lit(True)
        if self.start is not None:
            kept = kept & (month >= F.lit(self.start))
        if self.end is not None:
            kept = kept & (month <= F.lit(self.end))
        return kept

    def workdays(self, df: DataFrame, name: str = "workdate") -> Column:
        """The same months as a range of days, which reaches the file scan.

        The bounds are moved to whole months, so the result equals
        ``month_between`` applied after the monthly aggregation. Where the
        stored table carries its month as a partition column, whole folders
        are skipped as well.
        """
        kept = F.lit(True)
        day = F.col(name)
        partitioned = "month" in df.columns
        if self.start is not None:
            first = self.start if self.start.day == 1 else _next_month(self.start)
            kept = kept & (day >= F.lit(first))
            if partitioned:
                kept = kept & (F.col("month") >= F.lit(first))
        if self.end is not None:
            kept = kept & (day < F.lit(_next_month(self.end)))
            if partitioned:
                kept = kept & (F.col("month") <= F.lit(self.end))
        return kept
