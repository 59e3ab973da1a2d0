from datetime import date
from decimal import Decimal

import pytest
from small import beds, day, facility, gold

from wardlake.plans import views

D = Decimal


@pytest.fixture
def tables(spark):
    return gold(
        spark,
        [
            day("2024-04-01", "AL", "1", rn=10, lpn=20, residents=40, ctr=4),
            day("2024-04-02", "AL", "1", cna=30, residents=0),
            day("2024-05-31", "AL", "1", rn=1, residents=None),
            day("2024-04-01", "TX", "2", rn=8, residents=4),
            day("2024-04-01", "TX", "3"),
        ],
        [beds("1", "AL", 50), beds("2", "TX", 0), beds("2", "OK", 70)],
        [facility("1", "Oak", "AL"), facility("3", "Elm", "TX")],
    )


def by_key(df, *names):
    return {tuple(row[name] for name in ("ccn", "month")): tuple(row[name] for name in names)
            for row in df.collect()}


APRIL, MAY = date(2024, 4, 1), date(2024, 5, 1)


def test_hours_count_missing_roles_as_zero(tables):
    rows = by_key(views.hours_facility_monthly(tables), "provider_name", "total_hours_direct")
    assert rows == {
        ("1", APRIL): ("Oak", D(60)), ("1", MAY): ("Oak", D(1)),
        ("2", APRIL): (None, D(8)), ("3", APRIL): ("Elm", D(0)),
    }


def test_state_hours_are_the_sum_of_facility_hours(tables):
    facility_sum = {}
    for row in views.hours_facility_monthly(tables).collect():
        key = (row.state, row.month)
        facility_sum[key] = facility_sum.get(key, D(0)) + row.total_hours_direct
    states = {(r.state, r.month): r.total_hours_direct
              for r in views.hours_state_monthly(tables).collect()}
    assert states == facility_sum


def test_employee_share(tables):
    rows = by_key(views.perm_vs_contract_monthly(tables), "emp_hours", "ctr_hours", "perm_share")
    assert rows[("1", APRIL)] == (D(56), D(4), D("0.933333"))
    assert rows[("3", APRIL)] == (D(0), D(0), None)


def test_bed_utilization(tables):
    rows = by_key(views.bed_utilization_monthly(tables), "observed_days", "resident_days",
                  "certified_beds_reported", "bed_utilization_rate_monthly")
    assert rows[("1", APRIL)] == (2, D(40), 50, D("0.4000"))
    assert rows[("1", MAY)] == (1, D(0), 50, D("0.0000"))
    # No beds: unknown, not infinite. Beds of another state do not count.
    assert rows[("2", APRIL)] == (1, D(4), 0, None)
    assert rows[("3", APRIL)] == (1, D(0), None, None)


def test_every_day_of_a_month_is_counted_once(spark):
    days = [day(f"2024-05-{n:02d}", "AL", "1", rn=1, residents=1) for n in range(1, 32)]
    tables = gold(spark, days + days, [beds("1", "AL", 2)])
    row = views.bed_utilization_monthly(tables).first()
    assert (row.observed_days, row.resident_days) == (31, D(62))
    assert views.hprd_by_facility(tables).first().days_with_residents == 31


def test_a_changed_bed_count_gives_one_row_per_count(spark):
    tables = gold(
        spark, [day("2024-04-01", "AL", "1", rn=1, residents=10)],
        [beds("1", "AL", 50, "2024Q1"), beds("1", "AL", 40, "2024Q2"), beds("1", "AL", 40, "2024Q3")],
    )
    rows = views.bed_utilization_monthly(tables).orderBy("certified_beds_reported").collect()
    assert [row.bed_utilization_rate_monthly for row in rows] == [D("0.2500"), D("0.2000")]


def test_hours_per_resident_day(tables):
    rows = {r.ccn: r for r in views.hprd_by_facility(tables).collect()}
    oak = rows["1"]
    assert (oak.provider_name, oak.days_with_residents) == ("Oak", 1)
    assert (oak.start_date, oak.end_date) == (date(2024, 4, 1), date(2024, 5, 31))
    assert (oak.hprd_weighted, oak.rn_hprd, oak.lpn_hprd, oak.cna_hprd) == (
        D("1.525000"), D("0.275000"), D("0.500000"), D("0.750000"),
    )
    assert rows["3"].hprd_weighted is None
    states = {r.state: r.hprd_weighted for r in views.hprd_by_state(tables).collect()}
    assert states == {"AL": D("1.525000"), "TX": D("2.000000")}


def test_staffing_vs_occupancy_repeats_the_overall_rate(tables):
    rows = by_key(views.staffing_vs_occupancy(tables), "bed_utilization_rate_monthly", "hprd_weighted")
    assert rows[("1", APRIL)] == (D("0.4000"), D("1.525000"))
    assert rows[("1", MAY)] == (D("0.0000"), D("1.525000"))


def test_views_can_be_queried_by_name(spark, tables):
    views.register(tables)
    for name, view in views.VIEWS.items():
        assert spark.table(name).schema == view(tables).schema
    total = spark.sql(
        "SELECT sum(total_hours_direct) AS t FROM gold_vw_total_nurse_hours_state_monthly "
        "WHERE state = :state", args={"state": "AL"},
    ).first().t
    assert total == D(61)
