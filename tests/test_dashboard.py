from datetime import date
from decimal import Decimal

import pytest
from small import beds, day, facility, gold

from wardlake.operators.selection import Selection, in_or_all
from wardlake.plans import dashboard, views

D = Decimal
APRIL, MAY, JUNE = date(2024, 4, 1), date(2024, 5, 1), date(2024, 6, 1)


@pytest.fixture
def tables(spark):
    return gold(
        spark,
        [
            day("2024-04-10", "AL", "1", rn=100, residents=50, ctr=20),
            day("2024-05-10", "AL", "1", rn=150, residents=60),
            day("2024-06-30", "AL", "1", rn=75, residents=30, ctr=75),
            day("2024-04-10", "TX", "2", lpn=40, residents=20),
            day("2024-06-01", "TX", "2", lpn=50, residents=10),
            day("2024-05-31", "TX", "3", cna=10, residents=5),
            day("2024-04-10", "OK", "4", cna=0, residents=0),
        ],
        [beds("1", "AL", 100), beds("2", "TX", 40), beds("3", "TX", 10)],
        [facility("1", "Oak", "AL", 33.5, -86.5), facility("2", "Elm", "TX", 30.5, None),
         facility("4", "Ash", "OK", 35.0, -97.0)],
    )


def test_in_or_all(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(in_or_all("x", [])).count() == 3
    assert df.where(in_or_all("x", None)).count() == 3
    assert df.where(in_or_all("x", ["a", "c"])).count() == 1


@pytest.mark.parametrize(
    "start, end", [(APRIL, MAY), (date(2024, 4, 2), JUNE), (date(2024, 4, 1), date(2024, 5, 20)),
                   (None, MAY), (MAY, None), (date(2023, 12, 15), date(2024, 12, 31)), (JUNE, APRIL)],
)
def test_day_range_equals_the_filter_on_months(tables, start, end):
    chosen = Selection(start=start, end=end)
    early = views.hours_facility_monthly(tables.where(chosen))
    late = views.hours_facility_monthly(tables).where(chosen.month_between())
    assert sorted(map(tuple, early.collect()), key=str) == sorted(map(tuple, late.collect()), key=str)


def test_selection_boxes(tables):
    assert [r.state for r in dashboard.states(tables).collect()] == ["AL", "OK", "TX"]
    assert dashboard.default_states(tables).count() == 3
    rows = dashboard.facilities(tables, ["AL", "TX"]).collect()
    assert [r.provider_name for r in rows] == ["Elm", "Oak", None]
    picked = dashboard.facilities_by_label(tables, ["Oak (1) – AL", "nothing"])
    assert [r.ccn for r in picked.collect()] == ["1"]


def test_month_bounds(spark, tables):
    assert tuple(dashboard.month_bounds(tables).first()) == (APRIL, JUNE, APRIL)
    row = dashboard.month_bounds(gold(spark, [])).first()
    today = spark.sql("SELECT current_date() AS d").first().d
    assert row.max_month == today
    assert row.min_month == row.default_start < today


def test_hprd_ranking_leaves_out_unknown_rates(tables):
    rows = dashboard.facility_hprd_top(tables).collect()
    assert [r.ccn for r in rows] == ["2", "1", "3"]
    assert [r.ccn for r in dashboard.facility_hprd_top(tables, n=1).collect()] == ["2"]
    only = dashboard.facility_hprd_top(tables, Selection(states=["AL"], start=JUNE))
    assert [r.start_date for r in only.collect()] == [date(2024, 4, 10)]


def test_state_hprd_keeps_unknown_rates_at_the_end(tables):
    rows = dashboard.state_hprd(tables).collect()
    assert [r.state for r in rows] == ["TX", "AL", "OK"]
    assert rows[-1].hprd_weighted is None
    assert dashboard.state_hprd_kpi(tables).first()["count"] == 2


def test_hours_summary_drops_unnamed_facilities(tables):
    rows = {r.ccn: r for r in dashboard.facility_hours_summary(tables).collect()}
    assert set(rows) == {"1", "2", "4"}
    oak = rows["1"]
    assert (oak.avg_hours, oak.min_hours, oak.max_hours, oak.months) == (
        pytest.approx(325 / 3), D(75), D(150), 3,
    )
    assert (oak.p10, oak.p90) == (pytest.approx(80.0), pytest.approx(140.0))


def test_month_over_month_uses_the_previous_row_in_the_range(tables):
    rows = {(r.state, r.month): r for r in dashboard.state_hours_mom(tables).collect()}
    assert rows[("AL", APRIL)].mom_change is None
    assert rows[("AL", MAY)].mom_change == pytest.approx(0.5)
    assert rows[("TX", JUNE)].mom_change == pytest.approx(4.0)
    assert rows[("AL", MAY)].month_label == "2024-05"
    cut = dashboard.state_hours_mom(tables, Selection(start=MAY))
    assert {r.mom_change for r in cut.where("month = '2024-05-01'").collect()} == {None}


def test_change_over_zero_hours_is_unknown(spark):
    tables = gold(spark, [day("2024-04-01", "OK", "4", rn=0), day("2024-05-01", "OK", "4", rn=9)])
    assert [r.mom_change for r in dashboard.state_hours_mom(tables).collect()] == [None, None]


def test_ranked_states_of_the_latest_and_of_a_given_month(tables):
    assert [r.state for r in dashboard.state_hours_ranked(tables).collect()] == ["AL", "TX"]
    rows = dashboard.state_hours_ranked(tables, month=MAY).collect()
    assert [(r.state, r.mom_change) for r in rows] == [("AL", 0.5), ("TX", pytest.approx(-0.75))]


def test_first_and_last_month_of_states(tables):
    rows = {r.state: r for r in dashboard.state_hours_first_last(tables).collect()}
    assert (rows["AL"].first_hours, rows["AL"].last_hours, rows["AL"].delta) == (D(100), D(75), D(-25))
    assert rows["AL"].pct == pytest.approx(-0.25)
    assert (rows["OK"].last_hours, rows["OK"].delta, rows["OK"].n_fac_last) == (None, None, None)
    kpi = dashboard.state_hours_first_last_kpi(tables).first()
    assert (kpi["count"], kpi.delta_total) == (2, D(-15))


def test_one_month_has_no_first_and_last(tables):
    one = Selection.one_month(MAY)
    assert dashboard.state_hours_first_last(tables, one).collect() == []
    assert dashboard.bed_util_first_last(tables, one).collect() == []


def test_contract_share(tables):
    rows = {r.ccn: r for r in dashboard.perm_contract_month(tables).collect()}
    assert (rows["1"].emp_hours, rows["1"].ctr_hours, rows["1"].pct_contract) == (D(0), D(75), 1.0)
    assert rows["2"].pct_contract == 0.0
    april = {r.ccn: r for r in dashboard.perm_contract_month(tables, month=APRIL).collect()}
    assert april["1"].pct_contract == pytest.approx(0.2)
    assert april["4"].pct_contract is None
    by_share = dashboard.perm_contract_top(tables, month=APRIL)
    by_hours = dashboard.perm_contract_top(tables, month=APRIL, by="hours")
    assert [r.ccn for r in by_share.collect()] == ["1", "2", "4"]
    assert [r.ccn for r in by_hours.collect()] == ["1", "2", "4"]


def test_latest_contract_month_is_that_of_the_states_not_of_the_facilities(tables):
    # Facility 3 has no row in June, the latest month of its state.
    assert dashboard.perm_contract_month(tables, Selection(["TX"], ["3"])).collect() == []
    months = dashboard.perm_contract_months(tables, Selection(["TX"], ["3"]))
    assert [r.month for r in months.collect()] == [APRIL, MAY, JUNE]


def test_bed_utilization_panels(tables):
    rows = dashboard.bed_util_ranked(tables, month=APRIL).collect()
    # Equal rates are put in order of name.
    assert [(r.ccn, r.utilization) for r in rows] == [("2", D("0.5000")), ("1", D("0.5000"))]
    spread = {r.ccn: r for r in dashboard.bed_util_variability(tables).collect()}
    assert set(spread) == {"1", "2", "4"}
    assert spread["1"].res_days == D(140) and spread["1"].months == 3
    assert spread["1"].std_util == pytest.approx(0.152753, abs=1e-6)
    ranged = {r.ccn: r for r in dashboard.bed_util_variability(tables, metric="range").collect()}
    assert ranged["1"].var_util == pytest.approx(ranged["1"].p90 - ranged["1"].p10)
    ends = {r.ccn: r for r in dashboard.bed_util_first_last(tables).collect()}
    # Facility 4 has no beds, so neither month is known and it drops out.
    assert set(ends) == {"1", "2"}
    assert ends["1"].delta == pytest.approx(-0.2)


def test_first_and_last_use_days_of_all_months(tables):
    ends = {r.ccn: r.res_days for r in dashboard.bed_util_first_last(tables).collect()}
    assert ends == {"1": D(140), "2": D(30)}


def test_map_shows_placed_facilities_of_the_latest_month(tables):
    rows = dashboard.bed_util_map_points(tables).collect()
    assert [(r.ccn, r.color, r.radius) for r in rows] == [("1", [90, 88, 153, 170], 2000)]
    assert tuple(dashboard.bed_util_map_center(tables).first()) == (33.5, -86.5)


def test_staffing_vs_occupancy(tables):
    rows = {r.ccn: r for r in dashboard.staffing_vs_occupancy(tables).collect()}
    assert set(rows) == {"1", "2"}
    assert (rows["1"].monthly_avg_residents, rows["1"].hprd_monthly) == (D("30.0000"), D("2.5000"))
    assert [r.month for r in dashboard.staffing_occupancy_months(
        tables, Selection(ccns=["3"])).collect()] == [MAY]


def test_hours_are_matched_without_the_state(spark):
    # A facility that moved: both states' hours meet the one utilization row.
    tables = gold(
        spark,
        [day("2024-04-01", "AL", "1", rn=10, residents=5), day("2024-04-02", "GA", "1", rn=30, residents=5)],
    )
    rows = dashboard.staffing_vs_occupancy(tables, Selection(states=["AL"])).collect()
    assert sorted(r.total_hours_direct for r in rows) == [D(10), D(30)]
