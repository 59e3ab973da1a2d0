"""Exact summary statistics that hold for frames of any size.

A percentile over a whole frame would gather every value in one task. Here the
frame is first reduced to one row per distinct value with its count (partial
aggregation absorbs hot values). The pairs are sorted into ranges, and only the
ranges that hold a wanted rank are read: one way for few and for many values.
"""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.measures import mean
from wardlake.operators.ranges import PART, SortedRanges
from wardlake.session import written

BOX_EXTENT = 1.5


class ValueCounts:
    """Distinct non-NULL values of a column as ``value`` with their counts as ``n``, in ranges."""

    def __init__(self, df: DataFrame, column: str):
        counted = (
            df.where(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("value"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        self._ranges = SortedRanges(counted, [F.col("value")], F.col("n"))
        self.rows = self._ranges.rows.select("value", "n")

    def quantiles(self, probs: list[float]) -> list[float | None]:
        """Linear interpolation between the two order statistics around each wanted rank."""
        total = self._ranges.total
        if not total:
            return [None] * len(probs)
        places = [prob * (total - 1) for prob in probs]
        ranks = sorted({rank for place in places for rank in (floor(place), floor(place) + 1)})
        ranks = [rank for rank in ranks if rank < total]
        value = F.col("value").cast("double")
        found = self._ranges.stretch([(rank, rank + 1) for rank in ranks]).agg(
            *(F.min(F.when(F.col("_upto") > rank, value)) for rank in ranks)
        ).first()
        at = dict(zip(ranks, found, strict=True))
        results = []
        for place in places:
            low = at[floor(place)]
            high = at.get(floor(place) + 1, low)
            results.append(low + (place - floor(place)) * (high - low))
        return results


def grouped_quantiles(df: DataFrame, groups: list[str], column: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of the non-NULL values of each group, one column per name in ``probs``.

    Equal to ``percentile`` with linear interpolation, but no task holds a group: (group, value,
    count) is sorted into ranges, of which a large group fills many, and each range knows how many values
    of its groups come before it. Groups without values are left out.
    """
    counted = (
        df.where(F.col(column).isNotNull())
        .groupBy(*groups, F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = SortedRanges(counted, [*(F.col(name) for name in groups), F.col("value")], F.col("n")).rows
    whole = Window.partitionBy(*groups)
    before = F.sum("here").over(whole.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    # One row per group and range that it reaches into.
    parts = rows.groupBy(PART, *groups).agg(F.sum("n").alias("here")).select(
        *(F.col(name).alias(f"_of_{name}") for name in (PART, *groups)),
        F.coalesce(before, F.lit(0)).alias("before"), F.sum("here").over(whole).alias("total"),
    )
    same = [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in (PART, *groups)]
    running = Window.partitionBy(PART, *groups).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(parts, same).withColumn("upto", F.col("before") + F.sum("n").over(running))
    value, found = F.col("value").cast("double"), []
    for name, prob in probs.items():
        place = F.lit(prob) * (F.col("total") - 1)
        for side, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.min(F.when(F.col("upto") > rank, value)).alias(f"_{name}_{side}"))
    rest = {name: F.lit(prob) * (F.col("_total") - 1) % 1 for name, prob in probs.items()}
    return (
        placed.groupBy(*groups).agg(F.first("total").alias("_total"), *found)
        .select(*groups, *(
            (F.col(f"_{name}_low") + rest[name] * (F.col(f"_{name}_high") - F.col(f"_{name}_low"))).alias(name)
            for name in probs
        ))
    )


def _weighted_mean() -> Column:
    return F.try_divide(
        F.sum(F.col("value") * F.col("n")).cast("double"), F.sum("n").cast("double")
    )


def kpi(
    df: DataFrame,
    column: str,
    extra: dict[str, Column] | None = None,
    bounded: bool = False,
) -> DataFrame:
    """One row: count, mean, median, min, max and p90 of the non-NULL values, and extras.

    ``extra`` maps names to aggregate columns over the whole frame, which is then kept, so that
    both come from one computation. Set ``bounded`` for a frame known to be short, such as a top-N
    report or one row per state: it is then summarised in a single aggregation, which holds all
    its values, so the caller answers for their number.
    """
    extra = extra or {}
    named = [expression.alias(name) for name, expression in extra.items()]
    if bounded:
        value = F.col(column)
        return df.agg(
            F.count(value).alias("count"),
            mean(column).alias("mean"),
            F.median(value).alias("median"),
            F.min(value).cast("double").alias("min"),
            F.max(value).cast("double").alias("max"),
            F.percentile(value, F.lit(0.9)).alias("p90"),
            *named,
        )
    if extra:
        df = written(df, "kpi")
    counts = ValueCounts(df, column)
    median, p90 = (F.lit(value).cast("double") for value in counts.quantiles([0.5, 0.9]))
    row = counts.rows.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        _weighted_mean().alias("mean"),
        median.alias("median"),
        F.min("value").cast("double").alias("min"),
        F.max("value").cast("double").alias("max"),
        p90.alias("p90"),
    )
    if not extra:
        return row
    return row.withColumn("_extra", df.agg(F.struct(*named)).scalar()).select(
        *row.columns, "_extra.*"
    )


def _round_width(edges: DataFrame, maxbins: int) -> DataFrame:
    """Add ``step``: 1, 2 or 5 times a power of ten that gives at most ``maxbins`` bins.

    One column per stage keeps each expression small.
    """
    width = F.col("high") - F.col("low")
    level = len(str(maxbins - 1)) if maxbins > 1 else 0
    span, step = F.col("span"), F.col("step")
    edges = edges.withColumn(
        "span",
        F.when(width > 0, width).when(F.col("low") != 0, F.abs("low")).otherwise(F.lit(1.0)),
    ).withColumn("step", F.pow(F.lit(10.0), F.floor(F.log10(span) + 0.5) - level))
    # Two enlargements always suffice: the first guess is within a factor of
    # ten to the one and a half of the number of bins asked for.
    for _ in range(2):
        edges = edges.withColumn(
            "step", F.when(F.ceil(span / step) > maxbins, step * 10).otherwise(step)
        )
    for part in (5, 2):
        edges = edges.withColumn(
            "step", F.when(span / (step / part) <= maxbins, step / part).otherwise(step)
        )
    return edges


def histogram(df: DataFrame, column: str, maxbins: int = 40) -> DataFrame:
    """Non-empty round-width bins of the non-NULL values: bin_start, bin_end, count."""
    counts = ValueCounts(df, column).rows.withColumn("value", F.col("value").cast("double"))
    low, high, step, start, stop = map(F.col, ("low", "high", "step", "start", "stop"))
    edges = (
        _round_width(counts.agg(F.min("value").alias("low"), F.max("value").alias("high")), maxbins)
        .withColumn("start", F.floor(low / step + 1e-9) * step)
        .withColumn("start", F.when(low < start, start - step).otherwise(start))
        .withColumn("stop", F.ceil(high / step) * step)
        .withColumn("stop", F.when(stop == start, start + step).otherwise(stop))
        .select(F.struct("start", "stop", "step"))
    )
    start, stop, step = (F.col(f"edge.{name}") for name in ("start", "stop", "step"))
    inside = F.greatest(start, F.least(F.col("value"), stop - step))
    return (
        counts.withColumn("edge", edges.scalar())
        .withColumn("bin", F.floor((inside - start) / step + 1e-14))
        .groupBy(
            (start + step * F.col("bin")).alias("bin_start"),
            (start + step * (F.col("bin") + 1)).alias("bin_end"),
        )
        .agg(F.sum("n").alias("count"))
        .orderBy("bin_start")
    )


def _box(counts: ValueCounts) -> tuple[list[Column], Column]:
    """The three quartiles as constants, and whether ``value`` lies within the whiskers' reach."""
    q1, median, q3 = counts.quantiles([0.25, 0.5, 0.75])
    if q1 is None:
        return [F.lit(None).cast("double")] * 3, F.lit(None).cast("boolean")
    reach = BOX_EXTENT * (q3 - q1)
    inside = F.col("value").cast("double").between(F.lit(q1 - reach), F.lit(q3 + reach))
    return [F.lit(q1), F.lit(median), F.lit(q3)], inside


def boxplot(df: DataFrame, column: str) -> DataFrame:
    """One row: quartiles, whiskers (furthest values within 1.5 IQR) and outlier count."""
    counts = ValueCounts(df, column)
    (q1, median, q3), inside = _box(counts)
    value = F.col("value").cast("double")
    return counts.rows.agg(
        q1.alias("q1"), median.alias("median"), q3.alias("q3"),
        F.min(F.when(inside, value)).alias("lower_whisker"),
        F.max(F.when(inside, value)).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def outliers(df: DataFrame, column: str) -> DataFrame:
    """The rows whose value lies beyond the whiskers of ``boxplot``."""
    kept = written(df, "outliers")
    _, inside = _box(ValueCounts(kept, column))
    return kept.withColumn("value", F.col(column)).where(~inside).select(*df.columns)
