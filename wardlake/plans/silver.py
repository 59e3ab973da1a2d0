"""Raw strings to clean, typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import clean
from wardlake.operators.upsert import upsert
from wardlake.schemas import HOUR_ROLES, SILVER_PBJ_DAILY, SILVER_PROVIDERINFO
from wardlake.sources.bronze import from_file

# Spelling of the roles in the raw column names.
RAW_ROLES = {
    "rndon": "RNDON", "rnadmin": "RNadmin", "rn": "RN",
    "lpnadmin": "LPNadmin", "lpn": "LPN", "cna": "CNA",
}

PBJ_KEYS = ["ccn", "workdate"]
PROVIDER_KEYS = ["ccn"]
PROVIDER_CCN = "`cms_certification_number_(ccn)`"


def silver_pbj(bronze: DataFrame, source_path: str | list[str] | None = None, *more: Column) -> DataFrame:
    """Daily staffing rows of one raw file or some (of all without a path), and further columns."""
    hours = [
        clean.safe(f"Hrs_{RAW_ROLES[role]}{part}", "decimal(9,2)").alias(f"hrs_{role}{part}")
        for role in HOUR_ROLES
        for part in ("", "_emp", "_ctr")
    ]
    return from_file(bronze, source_path).select(
        clean.ccn_pbj("PROVNUM").alias("ccn"),
        clean.text("PROVNAME").alias("provider_name"),
        clean.text("CITY").alias("city"),
        clean.text("COUNTY_NAME").alias("county"),
        clean.safe("COUNTY_FIPS", "int").alias("county_fips"),
        clean.upper_text("STATE").alias("state"),
        clean.text("CY_Qtr").alias("cy_quarter"),
        clean.safe_date("WorkDate").alias("workdate"),
        clean.safe("MDScensus", "int").alias("mds_census_resident_count"),
        *hours,
        *more,
    )


def silver_providerinfo(
    bronze: DataFrame, source_path: str | None = None, *more: Column
) -> DataFrame:
    """Provider rows of one raw file (of all files without a path), and further columns."""
    # Raw column (left) of every silver column whose name differs.
    raw = {
        "city": "city_town", "county": "county_parish", "facility_location": "location",
    }
    columns = []
    for field in SILVER_PROVIDERINFO:
        name, source = field.name, raw.get(field.name, field.name)
        kind = field.dataType.simpleString()
        if name == "ccn":
            column = clean.ccn_provider(PROVIDER_CCN)
        elif name == "state":
            column = clean.upper_text(source)
        elif name == "processing_date":
            column = F.col(source)
        elif kind == "string":
            column = clean.text(source)
        elif name in ("latitude", "longitude"):
            column = F.nullif(F.col(source), F.lit("")).try_cast(kind)
        else:
            column = clean.safe(source, kind)
        columns.append(column.alias(name))
    return from_file(bronze, source_path).select(*columns, *more)


def merge_silver_pbj(target: DataFrame, source: DataFrame, on_null_key: str = "insert") -> DataFrame:
    """A later file overwrites the rows of its facility days."""
    return upsert(
        target.select(*SILVER_PBJ_DAILY.names), source, PBJ_KEYS, on_null_key=on_null_key
    )


def merge_silver_providerinfo(
    target: DataFrame, source: DataFrame, on_null_key: str = "insert"
) -> DataFrame:
    """A later file updates its facilities; its missing values keep the earlier ones."""
    return upsert(
        target.select(*SILVER_PROVIDERINFO.names), source, PROVIDER_KEYS,
        keep_old_when_null=True, on_null_key=on_null_key,
    )
