"""The data behind each dashboard panel, as lazy frames.

Every query takes the gold tables and a ``Selection``; a missing month means
the latest one selected. Frames are aggregated and ranked on the cluster, and
only the rows of the finished panel are left to collect.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.display import facility_label, marker_radius, utilization_rgba
from wardlake.functions.measures import (
    mean, month_begins_back, month_label, month_of, or_zero, positive_ratio, ratio,
)
from wardlake.operators.ranking import order, top_n
from wardlake.operators.selection import Selection, in_or_all
from wardlake.operators.stats import kpi
from wardlake.plans import views
from wardlake.plans.views import Gold

EVERYTHING = Selection()
DEFAULT_STATES = 6
DEFAULT_MONTHS_BACK = 3
ENDS = (0.10, 0.90)


def _with_ends(df: DataFrame) -> DataFrame:
    """Both ends of a spread, taken from one percentile buffer, as p10 and p90."""
    return df.withColumns({"p10": F.col("_ends")[0], "p90": F.col("_ends")[1]}).drop("_ends")


# --- months -----------------------------------------------------------------

def _month_edge(gold: Gold, edge) -> Column:
    """First (``F.min``) or last (``F.max``) selected month, read from one column alone.

    A stored table's partition column serves where there is one, else the day.
    """
    if gold.months is not None:
        return gold.months.agg(edge("month").alias("month")).scalar()
    stored = "month" in gold.daily.columns
    value = edge("month") if stored else month_of(edge("workdate"))
    return gold.daily.agg(value.alias("month")).scalar()


def _only_month(gold: Gold, month: date | None, latest_of: Gold | None = None) -> Gold:
    """The daily fact of one month; if none is given, the latest of ``latest_of`` or ``gold``."""
    if month is not None:
        return gold.where(Selection.one_month(month))
    latest = _month_edge(latest_of or gold, F.max)
    day = F.col("workdate")
    kept = (day >= latest) & (day < F.add_months(latest, 1))
    if "month" in gold.daily.columns:
        kept = kept & (F.col("month") == latest)
    return gold.cut(kept, F.col("month") == latest)


def _edge_months(gold: Gold) -> Gold:
    """The daily fact of the first and the last month alone, as ranges of days and month folders."""
    first, last = _month_edge(gold, F.min), _month_edge(gold, F.max)
    day = F.col("workdate")
    kept = (day < F.add_months(first, 1)) | (day >= last)
    if "month" in gold.daily.columns:
        kept = kept & F.col("month").isin(first, last)
    return gold.cut(kept, F.col("month").isin(first, last))


# --- selection boxes --------------------------------------------------------

def states(gold: Gold) -> DataFrame:
    """All known states in order."""
    return gold.month_keys().select("state").where(F.col("state").isNotNull()).distinct().orderBy("state")


def default_states(gold: Gold) -> DataFrame:
    """States selected at first: the first six, or all when there are no more."""
    return top_n(states(gold), DEFAULT_STATES, "state")


def facilities(gold: Gold, selected: list[str] | None = None) -> DataFrame:
    """Facilities of the states in name order, with the label shown for each."""
    pairs = gold.month_keys().where(in_or_all("state", selected)).select("ccn", "state").distinct()
    return (
        pairs.join(gold.about(), "ccn", "left")
        .select("ccn", "provider_name", "state")
        .distinct()
        .withColumn("label", facility_label(F.col("provider_name"), F.col("ccn"), F.col("state")))
        .orderBy(*order("provider_name", "ccn", "state"))
    )


def facilities_by_label(gold: Gold, labels: list[str], selected: list[str] | None = None) -> DataFrame:
    """Facilities whose shown label was picked."""
    return facilities(gold, selected).where(F.col("label").isin(labels))


def month_bounds(gold: Gold) -> DataFrame:
    """One row: first and last month, and the start selected at first.

    Without data the range ends today and starts three month starts back.
    """
    today = F.current_date()
    return (
        gold.month_keys().agg(F.min("month").alias("min_month"), F.max("month").alias("max_month"))
        .select(
            F.coalesce("min_month", month_begins_back(today, DEFAULT_MONTHS_BACK)).alias("min_month"),
            F.when(F.col("min_month").isNull(), today).otherwise(F.col("max_month")).alias("max_month"),
        )
        .withColumn(
            "default_start",
            F.greatest("min_month", month_begins_back(F.col("max_month"), DEFAULT_MONTHS_BACK)),
        )
    )


# --- hours per resident day -------------------------------------------------

def facility_hprd(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """All facilities; the rate covers all their days, whatever months are set.

    A facility without residents has no rate and stays in tables and exports.
    """
    keyed = Selection(states=selection.states, ccns=selection.ccns)
    return views.hprd_by_facility(gold.where(keyed))


def known_facility_hprd(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """The facilities with a known rate, which charts and figures are drawn from."""
    return facility_hprd(gold, selection).where(F.col("hprd_weighted").isNotNull())


def facility_hprd_top(gold: Gold, selection: Selection = EVERYTHING, n: int = 50) -> DataFrame:
    """Facilities with the most hours per resident day."""
    return top_n(
        known_facility_hprd(gold, selection), n, "-hprd_weighted", "provider_name", "ccn", "state"
    )


def facility_hprd_kpi(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    return kpi(known_facility_hprd(gold, selection), "hprd_weighted")


def state_hprd(gold: Gold, selected: list[str] | None = None) -> DataFrame:
    """States by hours per resident day, highest first."""
    return views.hprd_by_state(gold.where(Selection(states=selected))).orderBy(
        *order("-hprd_weighted", "state")
    )


def state_hprd_kpi(gold: Gold, selected: list[str] | None = None) -> DataFrame:
    return kpi(state_hprd(gold, selected), "hprd_weighted", bounded=True)


# --- nurse hours ------------------------------------------------------------

def facility_hours_summary(
    gold: Gold, selection: Selection = EVERYTHING, n: int = 50
) -> DataFrame:
    """Spread of the monthly hours of the facilities with the highest average."""
    hours = F.col("total_hours_direct")
    # Facilities without a name are left out, as the group keys must be known.
    named = views.hours_facility_monthly(gold.where(selection)).dropna(
        subset=["ccn", "provider_name", "state"]
    )
    spread = named.groupBy("ccn", "provider_name", "state").agg(
        mean(hours).alias("avg_hours"),
        F.min(hours).alias("min_hours"),
        F.max(hours).alias("max_hours"),
        F.percentile(hours, ENDS).alias("_ends"),
        F.count(F.lit(1)).alias("months"),
    )
    return top_n(_with_ends(spread), n, "-avg_hours", "provider_name", "ccn", "state")


def facility_hours_kpi(gold: Gold, selection: Selection = EVERYTHING, n: int = 50) -> DataFrame:
    return kpi(
        facility_hours_summary(gold, selection, n), "avg_hours",
        {"facilities": F.count(F.lit(1))}, bounded=True,
    )


def state_hours_mom(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """State hours per month with facility count, average and change on the previous month.

    The previous month is the state's previous row within the selected months.
    """
    chosen = Selection(states=selection.states, start=selection.start, end=selection.end)
    months = gold.where(chosen).rolled_up()
    known = F.col("state").isNotNull() & F.col("month").isNotNull()
    per_state = months.groupBy("state", "month").agg(
        F.sum("total_hours_direct").cast(views.HOURS).alias("total_hours_direct"),
        # One row per facility and month, so counting rows counts facilities.
        F.count("ccn").alias("n_facilities"),
    )
    hours = F.col("total_hours_direct").cast("double")
    before = F.lag(hours).over(Window.partitionBy("state").orderBy("month"))
    return (
        per_state.withColumn(
            "n_facilities", F.when(known, F.col("n_facilities")).otherwise(F.lit(0))
        )
        .withColumn("month_label", month_label("month"))
        .withColumn("mom_change", F.try_divide(hours - before, before))
        .withColumn("avg_per_fac", positive_ratio(hours, F.col("n_facilities")))
        .select(
            "state", "month", "month_label", "total_hours_direct", "n_facilities",
            "mom_change", "avg_per_fac",
        )
        .orderBy(*order("month", "state"))
    )


def month_choices(monthly: DataFrame) -> DataFrame:
    """Sorted months of a monthly frame with their labels."""
    return (
        monthly.where(F.col("month").isNotNull())
        .select("month")
        .distinct()
        .withColumn("month_label", month_label("month"))
        .orderBy("month")
    )


def state_hours_ranked(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None
) -> DataFrame:
    """States of one month by hours; the change still refers to the month before it."""
    chosen = F.lit(month) if month is not None else _month_edge(gold.where(
        Selection(states=selection.states, start=selection.start, end=selection.end)), F.max)
    return state_hours_mom(gold, selection).where(F.col("month") == chosen).orderBy(
        *order("-total_hours_direct", "state")
    )


def state_hours_kpi(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None
) -> DataFrame:
    return kpi(
        state_hours_ranked(gold, selection, month), "total_hours_direct",
        {"states": F.count_distinct("state"), "avg_per_facility": F.avg("avg_per_fac")},
        bounded=True,
    )


def _first_and_last(df: DataFrame, gold: Gold) -> DataFrame:
    """Rows with the first and last selected month beside them; none if these coincide."""
    return (
        df.withColumn("_first", _month_edge(gold, F.min))
        .withColumn("_last", _month_edge(gold, F.max))
        .where(F.col("_first") < F.col("_last"))
    )


def _at(edge: str, value: Column | str) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("month") == F.col(edge), column)


def state_hours_change(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """Each state's hours in the first and the last selected month and the change between.

    The fact is cut down to these two months before the roll-up.
    """
    chosen = Selection(states=selection.states, start=selection.start, end=selection.end)
    cut = gold.where(chosen)
    edges = _edge_months(cut).rolled_up().groupBy("state", "month").agg(
        F.sum("total_hours_direct").cast(views.HOURS).alias("total_hours_direct"),
        F.count("ccn").alias("n_facilities"),
    )
    monthly = _first_and_last(edges, cut).where(F.col("state").isNotNull())
    return (
        monthly.groupBy("state")
        .agg(
            F.sum(_at("_first", "total_hours_direct")).cast(views.HOURS).alias("first_hours"),
            F.sum(_at("_last", "total_hours_direct")).cast(views.HOURS).alias("last_hours"),
            F.max(_at("_first", "n_facilities")).alias("n_fac_first"),
            F.max(_at("_last", "n_facilities")).alias("n_fac_last"),
        )
        .withColumn("delta", (F.col("last_hours") - F.col("first_hours")).cast(views.HOURS))
        .withColumn("pct", positive_ratio(F.col("delta"), F.col("first_hours")))
    )


def state_hours_first_last(
    gold: Gold, selection: Selection = EVERYTHING, n: int = 20
) -> DataFrame:
    """The largest states by either month, in order of the last one."""
    sized = state_hours_change(gold, selection).withColumn(
        "rank_key", F.greatest("first_hours", "last_hours")
    )
    return top_n(sized, n, "-rank_key", "state").drop("rank_key").orderBy(
        *order("-last_hours", "state")
    )


def state_hours_first_last_kpi(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    return kpi(
        state_hours_change(gold, selection), "last_hours",
        {
            "delta_total": F.coalesce(F.sum("delta"), F.lit(0)).cast(views.HOURS),
            "median_pct": F.median("pct"),
        },
        bounded=True,
    )


# --- employees and contractors ----------------------------------------------

def perm_contract_months(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """Months that can be picked for the states; a facility choice does not matter here."""
    chosen = Selection(states=selection.states, start=selection.start, end=selection.end)
    return (
        gold.where(chosen).month_keys().select("month")
        .where(F.col("month").isNotNull())
        .distinct()
        .orderBy("month")
    )


def perm_contract_month(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None
) -> DataFrame:
    """Employee and contract hours of each facility in one month, with the contract share."""
    keyed = Selection(states=selection.states, ccns=selection.ccns)
    # The latest month is that of the states, before facilities are picked.
    offered = gold.where(Selection(selection.states, None, selection.start, selection.end))
    monthly = _only_month(gold.where(keyed), month, offered)
    hours = or_zero("emp_hours") + or_zero("ctr_hours")
    return (
        views.perm_vs_contract_monthly(monthly)
        .join(gold.about(), "ccn", "left")
        .withColumn("total_hours", hours.cast(views.HOURS))
        .withColumn("pct_contract", positive_ratio(or_zero("ctr_hours"), F.col("total_hours")))
        .select(
            "state", "ccn", "month", "emp_hours", "ctr_hours", "provider_name",
            "total_hours", "pct_contract",
        )
    )


def perm_contract_kpi(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None
) -> DataFrame:
    return kpi(
        perm_contract_month(gold, selection, month), "pct_contract",
        {"total_hours": F.sum("total_hours").cast(views.HOURS)},
    )


# The two ways the facilities can be ranked.
PERM_CONTRACT_ORDERS = {
    "share": ("-pct_contract", "-total_hours", "provider_name"),
    "hours": ("-total_hours", "-pct_contract", "provider_name"),
}


def perm_contract_top(
    gold: Gold,
    selection: Selection = EVERYTHING,
    month: date | None = None,
    n: int = 50,
    by: str = "share",
) -> DataFrame:
    """Facilities of one month by contract share or by total hours."""
    ranked = PERM_CONTRACT_ORDERS[by]
    return top_n(perm_contract_month(gold, selection, month), n, *ranked, "ccn", "state")


def perm_contract_top_kpi(
    gold: Gold,
    selection: Selection = EVERYTHING,
    month: date | None = None,
    n: int = 50,
    by: str = "share",
) -> DataFrame:
    return kpi(
        perm_contract_top(gold, selection, month, n, by), "pct_contract",
        {
            "facilities": F.count(F.lit(1)),
            "total_hours": F.sum("total_hours").cast(views.HOURS),
            "median_contract": F.median("pct_contract"),
        },
        bounded=True,
    )


# --- bed utilization --------------------------------------------------------

def bed_util_rows(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """Bed utilization of every facility and month with its place, in no order."""
    return views.bed_utilization_monthly(gold.where(selection), "latitude", "longitude").select(
        "state", "provider_name", "ccn", "month",
        F.col("bed_utilization_rate_monthly").alias("utilization"),
        "resident_days", "observed_days", "certified_beds_reported",
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )


def bed_util_detail(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """The utilization rows in month order."""
    return bed_util_rows(gold, selection).orderBy(*order("month", "state", "ccn"))


def bed_util_kpi(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    return kpi(
        bed_util_rows(gold, selection), "utilization",
        {"facilities": F.count_distinct("ccn"), "months": F.count_distinct("month")},
    )


def bed_util_ranked(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None, n: int = 50
) -> DataFrame:
    """Facilities with the highest utilization in one month."""
    monthly = bed_util_rows(_only_month(gold.where(selection), month))
    known = monthly.where(F.col("utilization").isNotNull())
    return top_n(known, n, "-utilization", "provider_name", "ccn", "state", "certified_beds_reported")


def bed_util_variability(
    gold: Gold, selection: Selection = EVERYTHING, metric: str = "std", n: int = 100
) -> DataFrame:
    """Average and spread of utilization for the facilities with most resident days.

    ``metric`` is ``std`` for the standard deviation or ``range`` for p90 - p10.
    """
    rate = F.col("utilization")
    named = bed_util_rows(gold, selection).dropna(subset=["ccn", "provider_name", "state"])
    spread = named.groupBy("ccn", "provider_name", "state").agg(
        mean(rate).alias("avg_util"),
        F.stddev_samp(rate.cast("double")).alias("std_util"),
        F.percentile(rate, ENDS).alias("_ends"),
        F.coalesce(F.sum("resident_days"), F.lit(0)).cast(views.DAYS).alias("res_days"),
        F.count(F.lit(1)).alias("months"),
    )
    measure = {"std": F.col("std_util"), "range": F.col("p90") - F.col("p10")}[metric]
    return top_n(
        _with_ends(spread).withColumn("var_util", measure),
        n, "-res_days", "provider_name", "ccn", "state",
    )


def bed_util_variability_kpi(
    gold: Gold, selection: Selection = EVERYTHING, metric: str = "std", n: int = 100
) -> DataFrame:
    return kpi(
        bed_util_variability(gold, selection, metric, n), "avg_util",
        {"median_variability": F.median("var_util")}, bounded=True,
    )


def bed_util_first_last(
    gold: Gold, selection: Selection = EVERYTHING, n: int = 50
) -> DataFrame:
    """Utilization in the first and last month for the facilities with most resident days."""
    cut = gold.where(selection)
    rate = F.col("utilization")
    per_facility = (
        _first_and_last(bed_util_rows(cut), cut)
        .groupBy("ccn", "provider_name", "state")
        .agg(
            mean(_at("_first", rate)).alias("first_util"),
            mean(_at("_last", rate)).alias("last_util"),
            F.sum("resident_days").alias("_days"),
        )
        # Exposure is counted per facility over all its states.
        .withColumn("res_days", F.sum("_days").over(Window.partitionBy("ccn")).cast(views.DAYS))
        .drop("_days")
        .dropna(subset=["ccn", "provider_name", "state"])
        .where(F.col("first_util").isNotNull() | F.col("last_util").isNotNull())
        .withColumn("delta", F.col("last_util") - F.col("first_util"))
    )
    return top_n(per_facility, n, "-res_days", "provider_name", "ccn", "state").orderBy(
        *order("-last_util", "provider_name", "ccn", "state")
    )


def bed_util_map_points(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """Facilities of the latest month that have a place, with marker colour and size."""
    latest = bed_util_rows(_only_month(gold.where(selection), None))
    return (
        latest.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
        .withColumn("color", utilization_rgba(F.col("utilization")))
        .withColumn("radius", marker_radius(F.col("resident_days")))
    )


def bed_util_map_center(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """One row: mean latitude and longitude of the map points."""
    return bed_util_map_points(gold, selection).agg(mean("lat").alias("lat"), mean("lon").alias("lon"))


# --- staffing against occupancy ---------------------------------------------

def staffing_occupancy_months(gold: Gold, selection: Selection = EVERYTHING) -> DataFrame:
    """Months that can be picked for the states and facilities."""
    return (
        gold.where(selection).month_keys().select("month")
        .where(F.col("month").isNotNull())
        .distinct()
        .orderBy("month")
    )


def staffing_vs_occupancy(
    gold: Gold, selection: Selection = EVERYTHING, month: date | None = None
) -> DataFrame:
    """Utilization, average residents and hours per resident day of one month.

    Hours are matched by facility and month alone, so the state choice cuts
    only the utilization side.
    """
    keyed = Selection(states=selection.states, ccns=selection.ccns)
    one = _only_month(gold, month, gold.where(selection))
    beds = views.bed_utilization_monthly(one.where(keyed))
    hours = one.where(Selection(ccns=selection.ccns)).rolled_up().select(
        "ccn", "month", "total_hours_direct"
    )
    days = F.col("resident_days").cast("decimal(18,4)")
    return beds.join(hours, ["ccn", "month"], "inner").select(
        "state", "provider_name", "ccn", "month",
        F.col("bed_utilization_rate_monthly").alias("utilization"),
        "resident_days", "observed_days",
        ratio(days, F.col("observed_days").cast("decimal(18,0)"), 4).alias("monthly_avg_residents"),
        "total_hours_direct",
        ratio(F.col("total_hours_direct").cast("decimal(18,2)"), days, 4).alias("hprd_monthly"),
    )
