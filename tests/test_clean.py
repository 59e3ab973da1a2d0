from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from wardlake.functions import clean
from wardlake.plans.silver import silver_pbj, silver_providerinfo
from wardlake.schemas import (
    BRONZE_PBJ, BRONZE_PROVIDERINFO, SILVER_PBJ_DAILY, SILVER_PROVIDERINFO,
)


def one_column(spark, values, expression):
    df = spark.createDataFrame([(value,) for value in values], "x string")
    return [row[0] for row in df.select(expression).collect()]


def test_schema_widths():
    assert len(BRONZE_PBJ) == 33
    assert len(BRONZE_PROVIDERINFO) == 103
    assert len(SILVER_PBJ_DAILY) == 27
    assert len(SILVER_PROVIDERINFO) == 23


def test_daily_key_keeps_letters_and_cuts_after_six(spark):
    keys = one_column(spark, [" 5009 ", "A5009", "45500912", "", "  ", None], clean.ccn_pbj("x"))
    assert keys == ["005009", "0A5009", "455009", None, None, None]


def test_provider_key_takes_the_rightmost_six_digits(spark):
    keys = one_column(
        spark, ["455009", " #45-5009 ", "99455009", "12", "abc", "", None], clean.ccn_provider("x")
    )
    assert keys == ["455009", "455009", "455009", "000012", None, None, None]


def test_five_digit_keys_would_merge_two_facilities(spark):
    # Keeping only five digits, as an off-by-one would, makes these two equal.
    df = spark.createDataFrame([("455009",), ("155009",)], "x string")
    five = df.selectExpr("lpad(right(x, 5), 6, '0') AS k").distinct()
    assert five.count() == 1
    assert df.select(clean.ccn_provider("x").alias("k")).distinct().count() == 2


def test_dates_in_both_spellings(spark):
    dates = one_column(
        spark, ["2024-04-01", " 20240401 ", "04/01/2024", "2024-13-01", "", None],
        clean.safe_date("x"),
    )
    assert dates == [date(2024, 4, 1), date(2024, 4, 1), None, None, None, None]


def test_unparsable_values_become_null(spark):
    assert one_column(spark, ["12", "12.5", "x", "", "99999999999"], clean.safe("x", "int")) == [
        12, None, None, None, None,
    ]
    assert one_column(spark, ["1.255", "12345678.9", "N/A"], clean.safe("x", "decimal(9,2)")) == [
        Decimal("1.26"), None, None,
    ]


def test_coercion_ignores_missing_columns(spark):
    df = spark.createDataFrame([("1.5", "2024-04-01 10:00:00"), ("x", "y")], "a string, b string")
    df = clean.coerce_datetime(clean.coerce_numeric(df, ["a", "nope"]), ["b", "nope"])
    assert [tuple(row) for row in df.collect()] == [
        (1.5, datetime(2024, 4, 1, 10)), (None, None),
    ]


def test_silver_types_and_values(spark):
    cells = {name: None for name in BRONZE_PBJ.names}
    cells |= {"PROVNUM": " 15009", "STATE": " al ", "WorkDate": "20240401", "Hrs_RN": "7.125",
              "Hrs_CNA_ctr": "N/A", "MDScensus": "40"}
    raw = spark.createDataFrame([tuple(cells.values())], BRONZE_PBJ)
    clean_rows = silver_pbj(raw)
    assert clean_rows.schema.simpleString() == SILVER_PBJ_DAILY.simpleString()
    row = clean_rows.first()
    assert (row.ccn, row.state, row.workdate) == ("015009", "AL", date(2024, 4, 1))
    assert (row.hrs_rn, row.hrs_cna_ctr, row.mds_census_resident_count) == (
        Decimal("7.13"), None, 40,
    )


def test_silver_provider_types(spark):
    cells = {name: None for name in BRONZE_PROVIDERINFO.names}
    cells |= {"cms_certification_number_(ccn)": "455009", "latitude": "", "longitude": "-87.12345",
              "city_town": " Mobile ", "number_of_fines": "2"}
    raw = spark.createDataFrame([tuple(cells.values())], BRONZE_PROVIDERINFO)
    rows = silver_providerinfo(raw)
    assert rows.schema.simpleString() == SILVER_PROVIDERINFO.simpleString()
    row = rows.first()
    assert (row.ccn, row.latitude, row.longitude) == ("455009", None, Decimal("-87.1235"))
    assert (row.city, row.number_of_fines) == ("Mobile", 2)


def test_dates_in_mixed_forms(spark):
    texts = {
        "2024-04-01": datetime(2024, 4, 1), "20240401": datetime(2024, 4, 1), " 04/15/2024 ": datetime(2024, 4, 15),
        "2024-04-01 13:05:00": datetime(2024, 4, 1, 13, 5), "2024-04-01T13:05:00": datetime(2024, 4, 1, 13, 5),
        "04/15/2024 08:30:00": datetime(2024, 4, 15, 8, 30), "2024/04/01": datetime(2024, 4, 1),
        "15-Apr-2024": datetime(2024, 4, 15), "20241301": None, "not a date": None, "": None, "2024": None, "99/99/2024": None,
        None: None,
    }
    df = spark.createDataFrame([(text,) for text in texts], "a string")
    found = {row.raw: row.a for row in clean.coerce_datetime(df.withColumn("raw", F.col("a")), ["a"]).collect()}
    assert found == texts
    day = spark.createDataFrame([(date(2024, 4, 1),)], "a date")
    assert clean.coerce_datetime(day, ["a"]).first().a == datetime(2024, 4, 1)
