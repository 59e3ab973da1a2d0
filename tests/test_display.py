from datetime import date

import pytest
from pyspark.sql import functions as F

from wardlake.functions import display, measures


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "utilization, rgba",
    [(0.0, [20, 100, 210, 170]), (1.0, [255, 60, 20, 170]), (-3.0, [20, 100, 210, 170]),
     (7.5, [255, 60, 20, 170]), (0.5, [137, 80, 115, 170]), (None, [160, 160, 160, 140])],
)
def test_colours(spark, utilization, rgba):
    assert one(spark, display.utilization_rgba(F.lit(utilization).cast("double"))) == rgba


@pytest.mark.parametrize(
    "days, radius", [(None, 2000), (-5.0, 2000), (0.0, 2000), (40000.0, 4000), (12345.0, 2222),
                     (1e9, 12000)],
)
def test_radius(spark, days, radius):
    assert one(spark, display.marker_radius(F.lit(days).cast("double"))) == radius


def test_labels(spark):
    label = display.facility_label(F.lit("Oak"), F.lit("012345"), F.lit("TX"))
    assert one(spark, label) == "Oak (012345) – TX"
    unnamed = display.facility_label(F.lit(None).cast("string"), F.lit("012345"), F.lit("TX"))
    assert one(spark, unnamed) == "None (012345) – TX"


@pytest.mark.parametrize(
    "day, back", [(date(2024, 6, 1), date(2024, 3, 1)), (date(2024, 6, 15), date(2024, 4, 1)),
                  (date(2024, 1, 31), date(2023, 11, 1))],
)
def test_month_begins_back(spark, day, back):
    assert one(spark, measures.month_begins_back(F.lit(day), 3)) == back


def test_ratios(spark):
    assert one(spark, measures.positive_ratio(F.lit(1), F.lit(4))) == 0.25
    assert one(spark, measures.positive_ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, measures.positive_ratio(F.lit(1), F.lit(-4))) is None
    half_up = measures.ratio(F.lit(1).cast("decimal(18,6)"), F.lit(16).cast("decimal(18,6)"), 3)
    assert str(one(spark, half_up)) == "0.063"
    assert one(spark, measures.ratio(F.lit(1).cast("decimal(18,6)"),
                                     F.lit(0).cast("decimal(18,6)"), 6)) is None
