"""Silver rows to the two facts and the facility dimension."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions import clean
from wardlake.functions.measures import total
from wardlake.operators.upsert import upsert
from wardlake.schemas import GOLD_DAILY, GOLD_FACILITY_DIM, GOLD_QUARTERLY

DAILY_KEYS = ["ccn", "workdate"]
QUARTERLY_KEYS = ["ccn", "reporting_period_quarter"]
DIM_KEYS = ["ccn"]

DEFAULT_QUARTER = "2024Q2"

# A matched quarterly row keeps the period it was inserted with.
QUARTERLY_UPDATES = [
    name
    for name in GOLD_QUARTERLY.names
    if name not in (*QUARTERLY_KEYS, "reporting_period_start", "reporting_period_end")
]

# Gold measure (left) taken from its silver column (right).
QUARTERLY_SOURCES = {
    "residents_per_day_reported": "average_number_of_residents_per_day",
    "total_nurse_hprd_adj_reported": "adjusted_total_nurse_staffing_hours_per_resident_per_day",
    "total_nurse_hprd_reported": "reported_total_nurse_staffing_hours_per_resident_per_day",
    "certified_beds_reported": "number_of_certified_beds",
    "fines_count_reported": "number_of_fines",
    "fines_usd_reported": "total_amount_of_fines_in_dollars",
    "payment_denials_reported": "number_of_payment_denials",
    "penalties_reported": "total_number_of_penalties",
}


def quarter_bounds(quarter: str) -> tuple[date, date]:
    """First and last day of a quarter written like ``2024Q2``."""
    year, number = int(quarter[:4]), int(quarter[5:])
    first = date(year, 3 * number - 2, 1)
    following = date(year + number // 4, 3 * number % 12 + 1, 1)
    return first, following - timedelta(days=1)


def gold_daily(silver: DataFrame) -> DataFrame:
    """Daily staffing fact; the direct-care total counts missing roles as zero."""
    computed = {
        "hrs_total_direct": total("hrs_rn", "hrs_lpn", "hrs_cna"),
        "residents": F.col("mds_census_resident_count"),
    }
    return silver.select(
        *(
            computed.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
            for field in GOLD_DAILY
        )
    )


def gold_quarterly(silver: DataFrame, quarter: str = DEFAULT_QUARTER) -> DataFrame:
    """Provider measures of one reporting quarter."""
    first, last = quarter_bounds(quarter)
    computed = {name: F.col(source) for name, source in QUARTERLY_SOURCES.items()}
    computed |= {
        "reporting_period_start": F.lit(first),
        "reporting_period_end": F.lit(last),
        "reporting_period_quarter": F.lit(quarter),
        "snapshot_received_ts": F.current_timestamp(),
    }
    return silver.select(
        *(
            computed.get(field.name, F.col(field.name)).cast(field.dataType).alias(field.name)
            for field in GOLD_QUARTERLY
        )
    )


def gold_facility_dim(silver: DataFrame) -> DataFrame:
    """One descriptive row per facility."""
    return silver.select(
        "ccn",
        clean.text("provider_name").alias("provider_name"),
        clean.upper_text("state").alias("state"),
        clean.text("city").alias("city"),
        clean.text("county").alias("county"),
        clean.text("ownership_type").alias("ownership_type"),
        clean.safe("latitude", "decimal(9,4)").alias("latitude"),
        clean.safe("longitude", "decimal(9,4)").alias("longitude"),
    )


def merge_gold_daily(target: DataFrame, source: DataFrame, on_null_key: str = "insert") -> DataFrame:
    return upsert(target.select(*GOLD_DAILY.names), source, DAILY_KEYS, on_null_key=on_null_key)


def merge_gold_quarterly(
    target: DataFrame, source: DataFrame, on_null_key: str = "insert"
) -> DataFrame:
    return upsert(
        target.select(*GOLD_QUARTERLY.names), source, QUARTERLY_KEYS,
        update=QUARTERLY_UPDATES, on_null_key=on_null_key,
    )


def merge_gold_facility_dim(
    target: DataFrame, source: DataFrame, on_null_key: str = "insert"
) -> DataFrame:
    return upsert(
        target.select(*GOLD_FACILITY_DIM.names), source, DIM_KEYS, on_null_key=on_null_key
    )
