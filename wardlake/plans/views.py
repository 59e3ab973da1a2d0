"""Gold views as lazy frames over the facts and the dimension.

All views start from one roll-up to facility months, which a lake keeps up to date month by
month (``Gold.months``); without it they compute it from the daily fact. It combines on the
map side, so a shuffle carries at most one row per facility month and task, and
the optimizer drops the sums a view does not use. Distinct days within a month
are kept as one bit per day: unlike COUNT(DISTINCT) this is combined before the
shuffle too.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.measures import month_of, ratio, total
from wardlake.operators.selection import Selection

HOURS = "decimal(38,2)"
DAYS = "decimal(38,4)"


@dataclass(frozen=True)
class Gold:
    """The three gold tables, and the facility months of the daily fact where they are stored."""

    daily: DataFrame
    quarterly: DataFrame
    facilities: DataFrame
    months: DataFrame | None = None

    def where(self, selection: Selection) -> Gold:
        """The daily fact cut down before any aggregation.

        States, facilities and months are grouping keys of every view, so this
        equals filtering the finished views.
        """
        return self.cut(
            selection.keys() & selection.workdays(self.daily), selection.keys() & selection.month_between()
        )

    def cut(self, days: Column, months: Column) -> Gold:
        """Only some months or keys, told as a test of the days and as one of the facility months."""
        kept = None if self.months is None else self.months.where(months)
        return replace(self, daily=self.daily.where(days), months=kept)

    def rolled_up(self) -> DataFrame:
        """Facility months, stored or computed."""
        return facility_months(self.daily) if self.months is None else self.months

    def month_keys(self) -> DataFrame:
        """Month, state and facility of rows that hold every such triple at least once."""
        if self.months is not None:
            return self.months.select("month", "state", "ccn")
        return self.daily.select(month_of("workdate").alias("month"), "state", "ccn")

    @contextmanager
    def reused(self) -> Iterator[Gold]:
        """Keep the tables while several panels are computed from the same selection."""
        tables = [table for table in (self.daily, self.quarterly, self.facilities, self.months) if table is not None]
        kept = Gold(*(table.persist() for table in tables))
        try:
            yield kept
        finally:
            for table in tables:
                table.unpersist()

    def about(self, *columns: str) -> DataFrame:
        """Key, name and the given further columns of each facility."""
        return self.facilities.select("ccn", "provider_name", *columns)


def _days(seen: Column | None = None) -> Column:
    """Bit set of the days of the month on which ``seen`` holds."""
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth("workdate") - 1)
    return F.bit_or(bit if seen is None else F.when(seen, bit))


def _day_count(bits: str) -> Column:
    return F.coalesce(F.bit_count(bits), F.lit(0))


DIRECT = ("hrs_rn", "hrs_lpn", "hrs_cna")
EMPLOYED = ("hrs_rn_emp", "hrs_lpn_emp", "hrs_cna_emp")
CONTRACTED = ("hrs_rn_ctr", "hrs_lpn_ctr", "hrs_cna_ctr")


def _sums(*names: str) -> list[Column]:
    """One sum per hour column; adding up the few sums is cheaper than adding in every row."""
    return [F.sum(name).alias(f"_{name}") for name in names]


def _hours(*names: str) -> Column:
    return total(*(f"_{name}" for name in names)).cast(HOURS)


def facility_months(daily: DataFrame) -> DataFrame:
    """All sums the views need, one row per month, state and facility."""
    return (
        daily.groupBy(month_of("workdate").alias("month"), "state", "ccn")
        .agg(
            *_sums(*DIRECT, *EMPLOYED, *CONTRACTED),
            F.coalesce(F.sum("residents"), F.lit(0)).alias("resident_days"),
            _days().alias("days"),
            _days(F.col("residents") > 0).alias("resident_days_seen"),
            F.min("workdate").alias("first_day"),
            F.max("workdate").alias("last_day"),
        )
        .select(
            "month", "state", "ccn",
            _hours(*DIRECT).alias("total_hours_direct"),
            _hours("hrs_rn").alias("rn_hours"),
            _hours("hrs_lpn").alias("lpn_hours"),
            _hours("hrs_cna").alias("cna_hours"),
            _hours(*EMPLOYED).alias("emp_hours"),
            _hours(*CONTRACTED).alias("ctr_hours"),
            "resident_days", "days", "resident_days_seen", "first_day", "last_day",
        )
    )


def hours_facility_monthly(gold: Gold) -> DataFrame:
    """Total direct-care hours per facility and month."""
    months = gold.rolled_up().select("month", "state", "ccn", "total_hours_direct")
    return months.join(gold.about(), "ccn", "left").select(
        "month", "state", "ccn", "provider_name", "total_hours_direct"
    )


def hours_state_monthly(gold: Gold) -> DataFrame:
    """Total direct-care hours per state and month."""
    if gold.months is not None:
        hours = F.sum("total_hours_direct").cast(HOURS).alias("total_hours_direct")
        return gold.months.groupBy("month", "state").agg(hours).select("month", "state", "total_hours_direct")
    return (
        gold.daily.groupBy(month_of("workdate").alias("month"), "state")
        .agg(*_sums(*DIRECT))
        .select("month", "state", _hours(*DIRECT).alias("total_hours_direct"))
    )


def perm_vs_contract_monthly(gold: Gold) -> DataFrame:
    """Employee and contract hours and the employee share per facility and month."""
    both = (F.col("emp_hours") + F.col("ctr_hours")).cast("decimal(18,6)")
    return gold.rolled_up().select(
        "month", "state", "ccn", "emp_hours", "ctr_hours",
        ratio(F.col("emp_hours").cast("decimal(18,2)"), both, 6).alias("perm_share"),
    )


def bed_utilization_monthly(gold: Gold, *facility_columns: str) -> DataFrame:
    """Resident days over available bed days per facility and month.

    A facility whose bed count differs between quarters has one row per count.
    Further facility columns can be had from the same look-up as the name.
    """
    return _bed_utilization(gold, gold.rolled_up(), (), facility_columns)


def _bed_utilization(
    gold: Gold, months: DataFrame, kept: tuple[str, ...], facility_columns: tuple[str, ...]
) -> DataFrame:
    """Utilization of rolled-up months; ``kept`` columns of the roll-up are passed on."""
    months = months.select(
        "month", "state", "ccn",
        _day_count("days").cast("bigint").alias("observed_days"),
        F.col("resident_days").cast(DAYS).alias("resident_days"),
        *kept,
    )
    beds = gold.quarterly.select("ccn", "state", "certified_beds_reported").distinct()
    bed_days = F.col("certified_beds_reported").cast("decimal(18,4)") * F.col("observed_days")
    return (
        months.join(beds, ["ccn", "state"], "left")
        .join(gold.about(*facility_columns), "ccn", "left")
        .select(
            "month", "state", "ccn", "provider_name", "observed_days", "resident_days",
            "certified_beds_reported",
            ratio(F.col("resident_days").cast("decimal(18,4)"), bed_days, 4)
            .alias("bed_utilization_rate_monthly"),
            *kept, *facility_columns,
        )
    )


def _hprd(hours: Column | str) -> Column:
    """Hours per resident day; the sums are divided in full width, only the rate is narrow."""
    column = F.col(hours) if isinstance(hours, str) else hours
    return ratio(column.cast("decimal(38,6)"), F.col("resident_days").cast("decimal(38,0)"), 6)


def _facility_hprd(months: DataFrame) -> DataFrame:
    added = ("rn_hours", "lpn_hours", "cna_hours", "resident_days")
    return (
        months.groupBy("ccn", "state")
        .agg(
            F.sum(_day_count("resident_days_seen")).alias("days_with_residents"),
            F.min("first_day").alias("start_date"),
            F.max("last_day").alias("end_date"),
            *(F.sum(name).alias(name) for name in added),
        )
        .select(
            "ccn", "state", "days_with_residents", "start_date", "end_date",
            _hprd(total("rn_hours", "lpn_hours", "cna_hours")).alias("hprd_weighted"),
            _hprd("rn_hours").alias("rn_hprd"),
            _hprd("lpn_hours").alias("lpn_hprd"),
            _hprd("cna_hours").alias("cna_hprd"),
        )
    )


def hprd_by_facility(gold: Gold) -> DataFrame:
    """Hours per resident day of each facility over all its days, weighted by residents."""
    return _facility_hprd(gold.rolled_up()).join(gold.about(), "ccn", "left").select(
        "ccn", "provider_name", "state", "days_with_residents", "start_date", "end_date",
        "hprd_weighted", "rn_hprd", "lpn_hprd", "cna_hprd",
    )


def hprd_by_state(gold: Gold) -> DataFrame:
    """Hours per resident day of each state over all its days, weighted by residents."""
    if gold.months is not None:
        months = gold.months.groupBy("state").agg(
            F.min("first_day").alias("start_date"),
            F.max("last_day").alias("end_date"),
            F.sum("resident_days").alias("resident_days"),
            F.sum("total_hours_direct").cast(HOURS).alias("total_hours_direct"),
        )
        return months.select("state", "start_date", "end_date", _hprd("total_hours_direct").alias("hprd_weighted"))
    return (
        gold.daily.groupBy("state")
        .agg(
            F.min("workdate").alias("start_date"),
            F.max("workdate").alias("end_date"),
            F.sum("residents").alias("resident_days"),
            *_sums(*DIRECT),
        )
        .select("state", "start_date", "end_date", _hprd(_hours(*DIRECT)).alias("hprd_weighted"))
    )


def staffing_vs_occupancy(gold: Gold) -> DataFrame:
    """Monthly bed utilization beside the facility's overall hours per resident day.

    The overall rate is a window over the facility's rolled-up months, so the fact is read and
    rolled up once. A facility has one row per month there.
    """
    facility = Window.partitionBy("ccn", "state")
    months = gold.rolled_up()
    hours = F.sum("total_hours_direct").over(facility).cast("decimal(38,6)")
    residents = F.sum("resident_days").over(facility).cast("decimal(38,0)")
    # Without a key no overall rate can be looked up.
    keyed = F.col("ccn").isNotNull() & F.col("state").isNotNull()
    months = months.withColumn("hprd_weighted", F.when(keyed, ratio(hours, residents, 6)))
    return _bed_utilization(gold, months, ("hprd_weighted",), ()).select(
        "month", "state", "ccn", "provider_name", "bed_utilization_rate_monthly", "hprd_weighted"
    )


# Names the views are known by.
VIEWS = {
    "gold_vw_total_nurse_hours_facility_monthly": hours_facility_monthly,
    "gold_vw_total_nurse_hours_state_monthly": hours_state_monthly,
    "gold_vw_perm_vs_contract_facility_monthly": perm_vs_contract_monthly,
    "gold_vw_bed_utilization_facility_monthly": bed_utilization_monthly,
    "gold_vw_staffing_vs_occupancy": staffing_vs_occupancy,
    "gold_vw_hprd_by_facility": hprd_by_facility,
    "gold_vw_hprd_by_state": hprd_by_state,
}


def register(gold: Gold) -> None:
    """Make the tables and views available to ``spark.sql`` in this session."""
    gold.daily.createOrReplaceTempView("gold_daily_staffing_fact")
    gold.quarterly.createOrReplaceTempView("gold_quarterly_provider_fact")
    gold.facilities.createOrReplaceTempView("gold_facility_dim")
    for name, view in VIEWS.items():
        view(gold).createOrReplaceTempView(name)
