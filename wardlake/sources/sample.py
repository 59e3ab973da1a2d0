"""Gold tables and raw files derived from a TPC-H-like star schema.

Suppliers stand for facilities, nations for states and line items for worked
hours. The line items are aggregated to supplier days before the supplier is
looked up, so the join never sees more than one row per supplier and day.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.plans.views import Gold
from wardlake.schemas import BRONZE_PBJ, BRONZE_PROVIDERINFO, GOLD_DAILY, HOUR_ROLES
from wardlake.session import shuffles_cleaned
from wardlake.sources.bronze import csv_options

# Two raw files with a common span of days, so that the second corrects the first.
FIRST_FILE_BEFORE = date(1998, 7, 1)
SECOND_FILE_FROM = date(1998, 4, 1)

# Two raw provider files that share the balances in between.
FIRST_FILE_BALANCE_BELOW = 7000
SECOND_FILE_BALANCE_FROM = 2000

# Raw rows that a task writes into a file.
FILE_ROWS = 500_000

# Facilities below this balance have no row in the dimension.
DIM_BALANCE_FROM = 0


# Columns used here; with a given schema no job is needed to read it from the files.
TABLES = {
    "lineitem": "l_orderkey bigint, l_suppkey bigint, l_quantity double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, ts timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with the names of their nation and region."""
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_name", "s_acctbal", "n_name", "r_name")
    )


def _ccn(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 6, "0")


def _residents() -> Column:
    """Residents of a day: unknown for some facilities, none on some days of others."""
    counted = F.col("orders") * 10 + F.col("l_suppkey") % 40
    empty = (F.col("l_suppkey") % 11 == 4) & (F.dayofmonth("workdate") % 3 == 0)
    return F.when(F.col("l_suppkey") % 13 == 5, F.lit(None)).when(empty, 0).otherwise(counted)


def daily_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Flag of the role (left) and of the contract kind among the line items.
    roles = {"rn": "R", "lpn": "A", "cna": "N"}
    kinds = {"": None, "_emp": "O", "_ctr": "F"}
    sums = {}
    for role, flag in roles.items():
        for kind, status in kinds.items():
            mine = F.col("l_returnflag") == flag
            if status:
                mine = mine & (F.col("l_linestatus") == status)
            sums[f"hrs_{role}{kind}"] = F.sum(F.when(mine, F.col("l_quantity")))
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("workdate"), "l_suppkey")
        .agg(
            *(column.cast("decimal(18,2)").alias(name) for name, column in sums.items()),
            F.count_distinct("l_orderkey").alias("orders"),
        )
    )
    whole = sum(
        (F.coalesce(F.col(f"hrs_{role}"), F.lit(0)) for role in roles), F.lit(0)
    )
    return (
        # Joined one by one: the size of a join is not known beforehand, that of a table is.
        days.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .withColumn("state", F.col("n_name"))
        .withColumn("ccn", _ccn("l_suppkey"))
        .withColumn("hrs_total_direct", whole.cast("decimal(18,2)"))
        .withColumn("residents", _residents().cast("int"))
        .select(*GOLD_DAILY.names)
    )


def facility_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facilities(spark, sf_dir).where(F.col("s_acctbal") >= DIM_BALANCE_FROM).select(
        _ccn("s_suppkey").alias("ccn"),
        F.col("s_name").alias("provider_name"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("city"),
        F.col("r_name").alias("county"),
        F.when(F.col("s_acctbal") < 5000, "Non profit").otherwise("For profit")
        .alias("ownership_type"),
        (25 + F.col("s_suppkey") % 23).cast("decimal(9,4)").alias("latitude"),
        (-70 - F.col("s_suppkey") % 50).cast("decimal(9,4)").alias("longitude"),
    )


def _beds() -> Column:
    return F.when(F.col("s_suppkey") % 17 == 3, 0).otherwise(50 + F.col("s_suppkey") % 151)


def quarterly_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    fines = (F.col("s_suppkey") % 4).cast("int")
    denials = (F.col("s_suppkey") % 3).cast("int")
    return _facilities(spark, sf_dir).select(
        _ccn("s_suppkey").alias("ccn"),
        F.col("n_name").alias("state"),
        F.lit(date(2024, 4, 1)).alias("reporting_period_start"),
        F.lit(date(2024, 6, 30)).alias("reporting_period_end"),
        F.lit("2024Q2").alias("reporting_period_quarter"),
        (20 + F.col("s_suppkey") % 80).cast("decimal(10,2)").alias("residents_per_day_reported"),
        (3 + F.col("s_suppkey") % 5).cast("decimal(10,4)").alias("total_nurse_hprd_adj_reported"),
        (2 + F.col("s_suppkey") % 5).cast("decimal(10,4)").alias("total_nurse_hprd_reported"),
        _beds().cast("int").alias("certified_beds_reported"),
        fines.alias("fines_count_reported"),
        (fines * 1000).cast("decimal(18,2)").alias("fines_usd_reported"),
        denials.alias("payment_denials_reported"),
        (fines + denials).alias("penalties_reported"),
        F.current_timestamp().alias("snapshot_received_ts"),
    )


def gold(spark: SparkSession, sf_dir: str) -> Gold:
    return Gold(
        daily_fact(spark, sf_dir), quarterly_fact(spark, sf_dir), facility_dim(spark, sf_dir)
    )


def bronze_pbj(spark: SparkSession, sf_dir: str, second_file: bool = False) -> DataFrame:
    """The daily fact as a raw file: padded, mixed case, with blanks and junk.

    The second file starts before the first one ends and reports one RN hour more.
    """
    return _raw_pbj(_days_of_file(daily_fact(spark, sf_dir), second_file), second_file)


def _days_of_file(fact: DataFrame, second_file: bool) -> DataFrame:
    day = F.col("workdate")
    return fact.where(day >= F.lit(SECOND_FILE_FROM) if second_file else day < F.lit(FIRST_FILE_BEFORE))


def _raw_pbj(fact: DataFrame, second_file: bool) -> DataFrame:
    day, number = F.col("workdate"), F.col("ccn").cast("int")
    # Roles the fact lacks repeat the hours of another one.
    hours_of = {"rndon": "lpn", "rnadmin": "cna", "rn": "rn", "lpnadmin": "rn",
                "lpn": "lpn", "cna": "cna"}
    raw = {}
    for role in HOUR_ROLES:
        for part in ("", "_emp", "_ctr"):
            hours = F.col(f"hrs_{hours_of[role]}{part}")
            if second_file and role == "rn":
                hours = hours + 1
            raw[f"hrs_{role}{part}"] = F.coalesce(
                hours.cast("decimal(18,2)").cast("string"), F.lit("")
            )
    raw["hrs_rn"] = F.when(number % 29 == 8, "N/A").otherwise(raw["hrs_rn"])
    raw |= {
        "provnum": F.format_string(" %d ", number),
        "provname": F.concat(F.lit("  Facility "), "ccn", F.lit(" ")),
        "city": F.concat(F.lit(" City "), F.right("ccn", F.lit(1))),
        "state": F.concat(F.lit(" "), F.lower("state"), F.lit("  ")),
        "county_name": F.concat(F.lit("County "), F.right("ccn", F.lit(2)), F.lit(" ")),
        "county_fips": F.when(number % 11 == 0, "unknown")
        .otherwise((number % 300).cast("string")),
        "cy_qtr": F.concat(F.year(day), F.lit("Q"), F.quarter(day)),
        "workdate": F.when((number % 23 == 6) & (F.dayofmonth(day) == 13), "not a date")
        .when(number % 19 == 4, F.date_format(day, "yyyyMMdd"))
        .otherwise(day.cast("string")),
        "mdscensus": F.when(number % 31 == 9, "N/A").otherwise(F.col("residents").cast("string")),
    }
    return fact.select(
        *(raw.get(name.lower(), F.lit("0")).alias(name) for name in BRONZE_PBJ.names)
    )


def bronze_providerinfo(spark: SparkSession, sf_dir: str, second_file: bool = False) -> DataFrame:
    """The facilities as a raw file; the second file updates some and leaves cells blank."""
    rows = _facilities(spark, sf_dir)
    key, balance = F.col("s_suppkey"), F.col("s_acctbal")
    if second_file:
        rows = rows.where(balance >= SECOND_FILE_BALANCE_FROM)
    else:
        rows = rows.where(balance < FIRST_FILE_BALANCE_BELOW)

    def padded(column: Column) -> Column:
        return F.concat(F.lit("  "), column.cast("string"), F.lit(" "))

    def blank_in_second(column: Column) -> Column:
        """NULL, as a blank cell is read, for every third facility of the second file."""
        return F.when(key % 3 != 0, column) if second_file else column

    fines = key % 4 + (1 if second_file else 0)
    raw = {
        "cms_certification_number_(ccn)": F.concat(F.lit(" #"), key.cast("string"), F.lit("-")),
        "provider_name": blank_in_second(padded(F.col("s_name"))),
        "provider_address": padded(F.concat(key.cast("string"), F.lit(" Main Street"))),
        "city_town": blank_in_second(padded(F.col("r_name"))),
        "state": padded(F.lower("n_name")),
        "zip_code": F.lpad((key * 7).cast("string"), 5, "0"),
        "telephone_number": F.lpad((key * 13).cast("string"), 10, "5"),
        "provider_ssa_county_code": (key % 90).cast("string"),
        "county_parish": padded(F.col("r_name")),
        "ownership_type": padded(
            F.when(balance < 5000, "Non profit").otherwise("For profit")
        ),
        "number_of_certified_beds": blank_in_second(_beds().cast("string")),
        "average_number_of_residents_per_day": F.concat((20 + key % 80).cast("string"), F.lit(".5")),
        "reported_total_nurse_staffing_hours_per_resident_per_day":
            F.concat((2 + key % 5).cast("string"), F.lit(".25")),
        "adjusted_total_nurse_staffing_hours_per_resident_per_day":
            F.when(key % 6 == 1, "N/A").otherwise(
                F.concat((3 + key % 5).cast("string"), F.lit(".75"))),
        "number_of_fines": fines.cast("string"),
        "total_amount_of_fines_in_dollars": F.concat((fines * 1000).cast("string"), F.lit(".5")),
        "number_of_payment_denials": (key % 3).cast("string"),
        "total_number_of_penalties": (fines + key % 3).cast("string"),
        "location": padded(F.concat(key.cast("string"), F.lit(" Main Street, "), F.col("r_name"))),
        "latitude": F.when(key % 8 == 2, "").otherwise((25 + key % 23).cast("string")),
        "longitude": blank_in_second((-70 - key % 50).cast("string")),
        "processing_date": F.lit("2024-11-01" if second_file else "2024-10-01"),
    }
    return rows.select(
        *(
            raw.get(name, F.lit(None)).cast("string").alias(name)
            for name in BRONZE_PROVIDERINFO.names
        )
    )


def write_raw(raw: DataFrame, path: str, compression: str = "none") -> None:
    """Add raw rows to a folder as CSV files, blanks around the text included."""
    kept = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "compression": compression}
    with shuffles_cleaned(raw.sparkSession):
        raw.write.mode("append").options(**csv_options(), **kept).csv(path)


def write_files(raw: DataFrame, path: str, *keys: str, files: int = 1, compression: str = "none") -> None:
    """Add raw rows to a folder in so many files, each in pieces of ``FILE_ROWS`` or so.

    With ``keys`` all rows of a key lie in one piece; without, rows are dealt out in turn.
    """
    write_raw(raw.repartition(_pieces(raw.count(), files), *keys), path, compression)


def _pieces(rows: int, files: int) -> int:
    return files * max(1, math.ceil(rows / files / FILE_ROWS))


def land_pbj(fact: DataFrame, path: str, second_file: bool, *keys: str, files: int = 1, copies: int = 1) -> None:
    """Add the raw rows of a daily fact to a folder, each so many times, as ``write_files`` does, but compressed.

    The days are dealt out, by ``keys`` of the fact, and repeated before they are rendered, as their rows are far narrower.
    """
    days = _days_of_file(fact, second_file)
    days = days.repartition(_pieces(days.count() * copies, files), *keys)
    if copies != 1:
        copy = F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")
        days = days.select("*", copy).drop("_copy")
    write_raw(_raw_pbj(days, second_file), path, "gzip")


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file-arrival message per event, for both datasets and a folder of neither."""
    number = F.col("event_id")
    folder = (
        F.when(number % 3 == 0, "bronze/pbj/")
        .when(number % 3 == 1, "bronze/providerinfo/")
        .otherwise("archive/pbj/")
    )
    name = F.concat(folder, F.lit("file_"), (number % 500).cast("string"), F.lit(".csv"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").alias("arrived"),
        F.to_json(
            F.struct(
                F.struct(
                    F.struct(F.lit("landing").alias("name")).alias("bucket"),
                    F.struct(name.alias("key")).alias("object"),
                ).alias("detail")
            )
        ).alias("body"),
    )
