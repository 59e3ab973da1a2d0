import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlake.operators import stats
from wardlake.operators.ranges import SortedRanges


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(value,) for value in values], f"v {kind}")


def skewed_values(seed):
    """A third of the values are one and the same; the rest spread over magnitudes."""
    rng = random.Random(seed)
    spread = [round(rng.lognormvariate(0, 3), 4) for _ in range(2000)]
    return spread + [1.5] * 1000


def test_kpi_is_exact(spark):
    values = skewed_values(1)
    row = stats.kpi(frame(spark, values), "v").first()
    assert row["count"] == len(values)
    assert row["mean"] == pytest.approx(np.mean(values))
    assert row["median"] == pytest.approx(np.median(values))
    assert (row["min"], row["max"]) == (min(values), max(values))
    assert row["p90"] == pytest.approx(np.quantile(values, 0.9))


PROBS = [0.0, 0.013, 0.25, 0.5, 0.77, 0.999, 1.0]


def test_quantiles_from_ranges(spark):
    values = skewed_values(2)
    counts = stats.ValueCounts(frame(spark, values), "v")
    assert counts.quantiles(PROBS) == pytest.approx(list(np.quantile(values, PROBS)))


def test_quantiles_of_decimals_and_of_one_value(spark):
    values = [Decimal(n).scaleb(-4) for n in range(0, 9000, 7)]
    counts = stats.ValueCounts(frame(spark, values, "decimal(18,4)"), "v")
    assert counts.quantiles(PROBS) == pytest.approx(list(np.quantile([float(v) for v in values], PROBS)))
    assert stats.ValueCounts(frame(spark, [3.0]), "v").quantiles(PROBS) == [3.0] * len(PROBS)
    assert stats.ValueCounts(frame(spark, []), "v").quantiles([0.5]) == [None]


def test_only_touched_ranges_are_read(spark):
    coalesced = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesced, "false")
    try:
        ranges = SortedRanges(spark.range(5000).toDF("v"), [F.col("v")])
    finally:
        spark.conf.unset(coalesced)
    rows = ranges.stretch([(10, 11)])
    assert rows.where("_upto = 11").first().v == 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan or "_part#" in plan.split("PartitionFilters:")[1][:80]
    assert rows.count() < 5000


def test_kpi_skips_nulls_and_adds_extras(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a")], "v double, s string")
    extra = {"states": F.count_distinct("s"), "rows": F.count(F.lit(1))}
    for bounded in (True, False):
        row = stats.kpi(df, "v", extra, bounded=bounded).first()
        assert (row["count"], row["mean"], row["median"]) == (2, 2.0, 2.0)
        assert (row["states"], row["rows"]) == (2, 3)


def test_kpi_of_nothing(spark):
    for bounded in (True, False):
        row = stats.kpi(frame(spark, []), "v", bounded=bounded).first()
        assert row["count"] == 0
        assert row["mean"] is None and row["median"] is None and row["p90"] is None


@pytest.mark.parametrize(
    "low, high, step",
    [(0.0, 0.9, 0.05), (0.0, 7.0, 0.2), (0.0, 83.0, 5.0), (0.0, 40.0, 1.0), (-3.0, 3.0, 0.2),
     (5.0, 5.0, 0.2), (0.0, 0.0, 0.05), (1000.0, 2000.0, 50.0)],
)
def test_histogram_steps(spark, low, high, step):
    rows = stats.histogram(frame(spark, [low, high, None]), "v").collect()
    assert sum(row["count"] for row in rows) == 2
    assert rows[0].bin_end - rows[0].bin_start == pytest.approx(step)
    assert rows[0].bin_start <= low and high <= rows[-1].bin_end + 1e-9


def test_histogram_bins_are_half_open_except_the_last(spark):
    rows = stats.histogram(frame(spark, [0.0, 1.0, 1.5, 2.0, 10.0]), "v", maxbins=10).collect()
    assert [(row.bin_start, row["count"]) for row in rows] == [
        (0.0, 1), (1.0, 2), (2.0, 1), (9.0, 1),
    ]


def test_boxplot_and_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, None]
    row = stats.boxplot(frame(spark, values), "v").first()
    assert (row.q1, row.median, row.q3) == (2.25, 3.5, 4.75)
    assert (row.lower_whisker, row.upper_whisker, row.outliers) == (1.0, 5.0, 1)
    assert [row.v for row in stats.outliers(frame(spark, values), "v").collect()] == [100.0]


def test_boxplot_of_many_values_and_of_none(spark):
    values = skewed_values(3)
    row = stats.boxplot(frame(spark, values), "v").first()
    assert (row.q1, row.median, row.q3) == pytest.approx(tuple(np.quantile(values, [0.25, 0.5, 0.75])))
    assert tuple(stats.boxplot(frame(spark, [None]), "v").first()) == (None, None, None, None, None, 0)
    assert stats.outliers(frame(spark, []), "v").count() == 0


def test_grouped_quantiles_equal_percentiles(spark):
    probs = {"low": 0.1, "median": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 == 7, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.when(F.col("id") % 11 != 3, (F.col("id") * 7919 % 501).cast("decimal(18,2)") / 4).alias("v"),
    )
    rows = rows.unionByName(spark.createDataFrame([("empty", None), ("one", 5)], "g string, v int"))
    found = {row.g: [row[name] for name in probs] for row in stats.grouped_quantiles(rows, ["g"], "v", probs).collect()}
    exact = rows.where("v IS NOT NULL").groupBy("g").agg(
        *(F.percentile("v", F.lit(prob)).alias(name) for name, prob in probs.items()))
    assert set(found) == {row.g for row in exact.collect()} and "empty" not in found and None in found
    for row in exact.collect():
        assert found[row.g] == pytest.approx([row[name] for name in probs])


def test_a_hot_group_fills_several_ranges(spark):
    """Most rows are of one group; its values are sorted into many ranges."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 20 != 0, 1).otherwise(2).alias("g"), F.col("id").alias("v"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counted = rows.groupBy("g", F.col("v").alias("value")).agg(F.count("v").alias("n"))
        ranges = SortedRanges(counted, [F.col("g"), F.col("value")], F.col("n"))
        assert ranges.rows.where("g = 1").select("_part").distinct().count() >= 3
        found = stats.grouped_quantiles(rows, ["g"], "v", {"median": 0.5}).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert {row.g: row.median for row in found} == {1: 10_000.0, 2: 9_990.0}
