"""Physical plans that have to hold when the data grows."""

from datetime import date

import pytest

import small
from __spark_entry__ import FILTERED_QUERIES, GOLD_QUERIES
from wardlake.functions.measures import month_of
from wardlake.operators import stats
from wardlake.operators.selection import Selection
from wardlake.plans import dashboard, views
from wardlake.plans.views import Gold
from wardlake.session import written
from wardlake.sources import sample
from wardlake.sources.tables import write_partitioned

SF_DIR = "/root/testdata/sf0.001"

# Units that keep an intermediate result first; the plan then starts from there.
EAGER = {"kpi_hprd", "kpi_perm_contract", "kpi_bed_util", "pager_facilities",
         "bed_util_histogram", "bed_util_boxplot", "bed_util_outliers"}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("gold"))
    tables = sample.gold(spark, SF_DIR)
    daily = tables.daily.withColumn("month", month_of("workdate"))
    write_partitioned(daily, f"{path}/daily", ["month"], ["state", "ccn"])
    write_partitioned(tables.quarterly, f"{path}/quarterly", [], ["ccn"])
    write_partitioned(tables.facilities, f"{path}/facilities", [], ["ccn"])
    return Gold(*(spark.read.parquet(f"{path}/{name}")
                  for name in ("daily", "quarterly", "facilities")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(df, column):
    return next(line for line in plan(df).splitlines() if "FileScan" in line and column in line)


@pytest.mark.parametrize("name", [name for name in GOLD_QUERIES if name not in EAGER])
def test_no_python_and_no_cross_join(stored, name):
    text = plan(GOLD_QUERIES[name](stored))
    for unwanted in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in text


def test_only_needed_columns_are_read(stored):
    scan = scan_of(views.hours_facility_monthly(stored), "hrs_rn")
    assert "hrs_rn_emp" not in scan and "residents" not in scan
    scan = scan_of(dashboard.states(stored), "state")
    assert "hrs" not in scan and "workdate" not in scan


def test_selection_reaches_the_scan(stored):
    chosen = Selection(["NATION_1"], ["000003"], date(1998, 1, 1), date(1998, 3, 1))
    scan = scan_of(dashboard.bed_util_detail(stored, chosen), "workdate")
    assert "PartitionFilters: [isnotnull(month" in scan
    for pushed in ("EqualTo(state,NATION_1)", "EqualTo(ccn,000003)",
                   "GreaterThanOrEqual(workdate,1998-01-01)", "LessThan(workdate,1998-04-01)"):
        assert pushed in scan


def test_monthly_sums_are_combined_before_the_shuffle(stored):
    text = plan(views.bed_utilization_monthly(stored))
    assert "partial_sum" in text and "partial_bit_or" in text
    # One shuffle of the fact and none for distinct days.
    assert "distinct" not in text.lower().split("filescan")[0]


def test_rankings_keep_n_rows_per_task(stored):
    for name in ("facility_hprd_top", "facility_hours_summary", "perm_contract_top_share",
                 "bed_util_ranked", "bed_util_variability_std"):
        assert "TakeOrderedAndProject" in plan(GOLD_QUERIES[name](stored))


def test_the_growing_side_is_never_broadcast(spark):
    text = plan(sample.daily_fact(spark, SF_DIR))
    assert "BuildLeft" not in text


def test_large_dimensions_are_not_broadcast(spark, stored):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        text = plan(views.bed_utilization_monthly(stored))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in text


def test_months_of_a_stored_table_come_from_its_folders(stored):
    text = plan(dashboard.bed_util_ranked(stored))
    assert "PartitionFilters: [isnotnull(month" in text


def test_reused_tables_are_released(stored):
    with stored.where(Selection(["NATION_1"])).reused() as kept:
        assert dashboard.states(kept).count() <= 1
        assert kept.daily.is_cached
        assert "InMemoryTableScan" in plan(views.hours_facility_monthly(kept))
    assert not kept.daily.is_cached


def fact_scans(df):
    """Scans of the stored daily fact, told by one of its columns."""
    df.collect()  # the final adaptive plan
    text = plan(df).split("== Initial Plan ==")[0]
    return [line for line in text.splitlines() if "FileScan" in line and "/daily" in line]


def test_staffing_view_reads_and_rolls_up_the_fact_once(stored):
    assert len(fact_scans(views.staffing_vs_occupancy(stored))) == 1


def test_first_and_last_month_are_cut_at_the_scan(stored):
    text = plan(dashboard.state_hours_change(stored))
    wide = [line for line in text.splitlines() if "FileScan" in line and "hrs_rn" in line]
    assert len(wide) == 1 and "month" in wide[0].split("PartitionFilters: [")[1].split("]")[0]


FILTERED = ["facility_hours_summary_filtered", "state_hours_mom_filtered", "bed_util_detail_filtered",
            "bed_util_ranked_filtered", "bed_util_variability_filtered", "perm_contract_month_filtered",
            "state_hours_first_last_filtered", "staffing_vs_occupancy_filtered"]


@pytest.mark.parametrize("name", FILTERED)
def test_filtered_units_prune_months_at_the_scan(stored, name):
    scans = [line for line in plan(FILTERED_QUERIES[name](stored)).splitlines()
             if "FileScan" in line and "hrs_" in line + "hrs_" * ("residents" in line)]
    assert scans
    for line in scans:
        assert "month" in line.split("PartitionFilters: [")[1].split("]")[0]


def test_kpi_with_extras_reads_the_fact_once(spark, stored):
    seen = []

    def counted(df, purpose):
        seen.append(len([line for line in plan(df).splitlines() if "FileScan" in line and "residents" in line]))
        return written(df, purpose)

    original = stats.written
    stats.written = counted
    try:
        row = dashboard.bed_util_kpi(stored)
    finally:
        stats.written = original
    assert seen == [1] and "residents" not in plan(row) and row.count() == 1


def test_rates_survive_sums_above_a_trillion(spark):
    days = [small.day(f"2024-04-{d:02d}", "AL", "1", rn=9_000_000_000_000, residents=2_000_000_000) for d in range(1, 29)]
    rows = views.hprd_by_state(small.gold(spark, days * 60)).collect()
    assert [float(r.hprd_weighted) for r in rows] == [4500.0]
    rows = views.hprd_by_facility(small.gold(spark, days * 60)).collect()
    assert [float(r.rn_hprd) for r in rows] == [4500.0]
