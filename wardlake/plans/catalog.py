"""Lasting raw tables, lake tables and views in the session's catalog.

Tables are external: the catalog holds where their files are, and dropping them leaves the files. Views
are stored as SQL text over them, so any session of the catalog can use them, also one that
does not have this library.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import SparkSession

from wardlake.sources.bronze import BRONZE_VIEWS, DATASETS, csv_options

if TYPE_CHECKING:
    from wardlake.streaming.ingest import Lake

# Days of a month are kept as one bit each in the facility months.
_OBSERVED = "CAST(bit_count(m.days) AS BIGINT)"
_HPRD = "CAST(try_divide(CAST({0} AS DECIMAL(38,6)), CAST({1} AS DECIMAL(38,0))) AS DECIMAL(18,6))"


def _hprd(hours: str, days: str = "sum(resident_days)") -> str:
    return _HPRD.format(hours, days)


_BEDS = f"""
SELECT m.month, m.state, m.ccn, d.provider_name, {_OBSERVED} AS observed_days,
  CAST(m.resident_days AS DECIMAL(38,4)) AS resident_days, b.certified_beds_reported,
  CAST(try_divide(CAST(m.resident_days AS DECIMAL(18,4)),
    CAST(b.certified_beds_reported AS DECIMAL(18,4)) * {_OBSERVED}) AS DECIMAL(18,4)) AS bed_utilization_rate_monthly
FROM {{db}}.gold_facility_months m
LEFT JOIN (SELECT DISTINCT ccn, state, certified_beds_reported FROM {{db}}.gold_quarterly_provider_fact) b
  ON b.ccn = m.ccn AND b.state = m.state
LEFT JOIN {{db}}.gold_facility_dim d ON d.ccn = m.ccn"""

# The views by name, in an order in which each finds those it uses.
VIEW_SQL = {
    "gold_vw_total_nurse_hours_facility_monthly": """
SELECT m.month, m.state, m.ccn, d.provider_name, m.total_hours_direct
FROM {db}.gold_facility_months m LEFT JOIN {db}.gold_facility_dim d ON d.ccn = m.ccn""",
    "gold_vw_total_nurse_hours_state_monthly": """
SELECT month, state, CAST(sum(total_hours_direct) AS DECIMAL(38,2)) AS total_hours_direct
FROM {db}.gold_facility_months GROUP BY month, state""",
    "gold_vw_perm_vs_contract_facility_monthly": """
SELECT month, state, ccn, emp_hours, ctr_hours,
  CAST(try_divide(CAST(emp_hours AS DECIMAL(18,2)), CAST(emp_hours + ctr_hours AS DECIMAL(18,6))) AS DECIMAL(18,6)) AS perm_share
FROM {db}.gold_facility_months""",
    "gold_vw_bed_utilization_facility_monthly": _BEDS,
    "gold_vw_hprd_by_facility": f"""
SELECT f.ccn, d.provider_name, f.state, f.days_with_residents, f.start_date, f.end_date,
  f.hprd_weighted, f.rn_hprd, f.lpn_hprd, f.cna_hprd
FROM (
  SELECT ccn, state, sum(coalesce(bit_count(resident_days_seen), 0)) AS days_with_residents,
    min(first_day) AS start_date, max(last_day) AS end_date,
    {_hprd("sum(rn_hours) + sum(lpn_hours) + sum(cna_hours)")} AS hprd_weighted,
    {_hprd("sum(rn_hours)")} AS rn_hprd, {_hprd("sum(lpn_hours)")} AS lpn_hprd, {_hprd("sum(cna_hours)")} AS cna_hprd
  FROM {{db}}.gold_facility_months GROUP BY ccn, state
) f LEFT JOIN {{db}}.gold_facility_dim d ON d.ccn = f.ccn""",
    "gold_vw_hprd_by_state": f"""
SELECT state, min(first_day) AS start_date, max(last_day) AS end_date, {_hprd("sum(total_hours_direct)")} AS hprd_weighted
FROM {{db}}.gold_facility_months GROUP BY state""",
    "gold_vw_staffing_vs_occupancy": """
SELECT b.month, b.state, b.ccn, b.provider_name, b.bed_utilization_rate_monthly, f.hprd_weighted
FROM {db}.gold_vw_bed_utilization_facility_monthly b
LEFT JOIN {db}.gold_vw_hprd_by_facility f ON f.ccn = b.ccn AND f.state = b.state""",
}


def define_bronze(spark: SparkSession, database: str, folders: dict[str, str], escape: str = "\\") -> None:
    """Enter raw CSV folders, given by dataset, as tables; an earlier table of the name is dropped."""
    for dataset, path in folders.items():
        name = f"{database}.{BRONZE_VIEWS[dataset]}"
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in DATASETS[dataset])
        options = ", ".join("'{}' '{}'".format(key, value.replace("\\", "\\\\")) for key, value in csv_options(escape).items())
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING csv OPTIONS ({options}) LOCATION '{path}'")


def define_lake(lake: Lake, database: str) -> None:
    """Enter the lake's tables as they are now, and create or replace the views over them.

    A later load is seen after the tables have been entered again; the views stay as they are.
    """
    lake.roll_up()
    for name, table in lake.tables().items():
        table.define(f"{database}.{name}")
    for name, text in VIEW_SQL.items():
        lake.spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS {text.format(db=database)}")
