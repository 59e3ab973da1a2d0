"""Explicit schemas of every layer; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT = T.StringType()
INT = T.IntegerType()
DOUBLE = T.DoubleType()
DATE = T.DateType()
TIMESTAMP = T.TimestampType()


def table(*columns: tuple[T.DataType, str]) -> T.StructType:
    """Schema from runs of column names that share a type."""
    return T.StructType(
        [T.StructField(name, kind) for kind, names in columns for name in names.split()]
    )


def _strings(names: str) -> T.StructType:
    return table((TEXT, names))


# Column names and order of the daily staffing file.
BRONZE_PBJ = _strings("""
    PROVNUM PROVNAME CITY STATE COUNTY_NAME COUNTY_FIPS CY_Qtr WorkDate MDScensus
    Hrs_RNDON Hrs_RNDON_emp Hrs_RNDON_ctr
    Hrs_RNadmin Hrs_RNadmin_emp Hrs_RNadmin_ctr
    Hrs_RN Hrs_RN_emp Hrs_RN_ctr
    Hrs_LPNadmin Hrs_LPNadmin_emp Hrs_LPNadmin_ctr
    Hrs_LPN Hrs_LPN_emp Hrs_LPN_ctr
    Hrs_CNA Hrs_CNA_emp Hrs_CNA_ctr
    Hrs_NAtrn Hrs_NAtrn_emp Hrs_NAtrn_ctr
    Hrs_MedAide Hrs_MedAide_emp Hrs_MedAide_ctr
""")

# Column names and order of the provider information file.
BRONZE_PROVIDERINFO = _strings("""
    cms_certification_number_(ccn)
    provider_name provider_address city_town state zip_code
    telephone_number provider_ssa_county_code county_parish ownership_type
    number_of_certified_beds average_number_of_residents_per_day
    average_number_of_residents_per_day_footnote provider_type provider_resides_in_hospital
    legal_business_name date_first_approved_to_provide_medicare_and_medicaid_services
    affiliated_entity_name affiliated_entity_id continuing_care_retirement_community
    special_focus_status abuse_icon most_recent_health_inspection_more_than_2_years_ago
    provider_changed_ownership_in_last_12_months with_a_resident_and_family_council
    automatic_sprinkler_systems_in_all_required_areas
    overall_rating overall_rating_footnote
    health_inspection_rating health_inspection_rating_footnote
    qm_rating qm_rating_footnote long_stay_qm_rating
    long_stay_qm_rating_footnote short_stay_qm_rating short_stay_qm_rating_footnote
    staffing_rating staffing_rating_footnote reported_staffing_footnote
    physical_therapist_staffing_footnote
    reported_nurse_aide_staffing_hours_per_resident_per_day
    reported_lpn_staffing_hours_per_resident_per_day
    reported_rn_staffing_hours_per_resident_per_day
    reported_licensed_staffing_hours_per_resident_per_day
    reported_total_nurse_staffing_hours_per_resident_per_day
    total_number_of_nurse_staff_hours_per_resident_per_day_on_the_weekend
    registered_nurse_hours_per_resident_per_day_on_the_weekend
    reported_physical_therapist_staffing_hours_per_resident_per_day
    total_nursing_staff_turnover total_nursing_staff_turnover_footnote
    registered_nurse_turnover registered_nurse_turnover_footnote
    number_of_administrators_who_have_left_the_nursing_home
    administrator_turnover_footnote nursing_case_mix_index nursing_case_mix_index_ratio
    case_mix_nurse_aide_staffing_hours_per_resident_per_day
    case_mix_lpn_staffing_hours_per_resident_per_day
    case_mix_rn_staffing_hours_per_resident_per_day
    case_mix_total_nurse_staffing_hours_per_resident_per_day
    case_mix_weekend_total_nurse_staffing_hours_per_resident_per_day
    adjusted_nurse_aide_staffing_hours_per_resident_per_day
    adjusted_lpn_staffing_hours_per_resident_per_day
    adjusted_rn_staffing_hours_per_resident_per_day
    adjusted_total_nurse_staffing_hours_per_resident_per_day
    adjusted_weekend_total_nurse_staffing_hours_per_resident_per_day
    rating_cycle_1_standard_survey_health_date
    rating_cycle_1_total_number_of_health_deficiencies
    rating_cycle_1_number_of_standard_health_deficiencies
    rating_cycle_1_number_of_complaint_health_deficiencies
    rating_cycle_1_health_deficiency_score
    rating_cycle_1_number_of_health_revisits
    rating_cycle_1_health_revisit_score
    rating_cycle_1_total_health_score
    rating_cycle_2_standard_health_survey_date
    rating_cycle_2_total_number_of_health_deficiencies
    rating_cycle_2_number_of_standard_health_deficiencies
    rating_cycle_2_number_of_complaint_health_deficiencies
    rating_cycle_2_health_deficiency_score
    rating_cycle_2_number_of_health_revisits
    rating_cycle_2_health_revisit_score
    rating_cycle_2_total_health_score
    rating_cycle_3_standard_health_survey_date
    rating_cycle_3_total_number_of_health_deficiencies
    rating_cycle_3_number_of_standard_health_deficiencies
    rating_cycle_3_number_of_complaint_health_deficiencies
    rating_cycle_3_health_deficiency_score
    rating_cycle_3_number_of_health_revisits
    rating_cycle_3_health_revisit_score
    rating_cycle_3_total_health_score
    total_weighted_health_survey_score
    number_of_facility_reported_incidents
    number_of_substantiated_complaints
    number_of_citations_from_infection_control_inspections
    number_of_fines total_amount_of_fines_in_dollars
    number_of_payment_denials total_number_of_penalties
    location latitude longitude geocoding_footnote processing_date
""")

# Typed hour columns kept in the silver daily table.
HOUR_ROLES = ("rndon", "rnadmin", "rn", "lpnadmin", "lpn", "cna")
HOUR_COLUMNS = [f"hrs_{role}{part}" for role in HOUR_ROLES for part in ("", "_emp", "_ctr")]

# Columns of the cleaned daily table, in order.
SILVER_PBJ_DAILY = table(
    (TEXT, "ccn provider_name city county"),
    (INT, "county_fips"),
    (TEXT, "state cy_quarter"),
    (DATE, "workdate"),
    (INT, "mds_census_resident_count"),
    (T.DecimalType(9, 2), " ".join(HOUR_COLUMNS)),
)

# Columns of the cleaned provider table, in order.
SILVER_PROVIDERINFO = table(
    (TEXT, "ccn state provider_name provider_address city county ownership_type zip_code"),
    (TEXT, "telephone_number provider_ssa_county_code"),
    (T.DecimalType(9, 4), "latitude longitude"),
    (TEXT, "facility_location geocoding_footnote"),
    (INT, "number_of_certified_beds"),
    (DOUBLE, "average_number_of_residents_per_day"),
    (DOUBLE, "reported_total_nurse_staffing_hours_per_resident_per_day"),
    (DOUBLE, "adjusted_total_nurse_staffing_hours_per_resident_per_day"),
    (INT, "number_of_fines"),
    (DOUBLE, "total_amount_of_fines_in_dollars"),
    (INT, "number_of_payment_denials total_number_of_penalties"),
    (TEXT, "processing_date"),
)

# Columns of the daily fact, in order.
GOLD_DAILY = table(
    (DATE, "workdate"),
    (TEXT, "state ccn"),
    (T.DecimalType(18, 2), "hrs_rn hrs_lpn hrs_cna hrs_total_direct"),
    (T.DecimalType(18, 2), "hrs_rn_emp hrs_rn_ctr hrs_lpn_emp hrs_lpn_ctr"),
    (T.DecimalType(18, 2), "hrs_cna_emp hrs_cna_ctr"),
    (INT, "residents"),
)

# Columns of the quarterly fact, in order.
GOLD_QUARTERLY = table(
    (TEXT, "ccn state"),
    (DATE, "reporting_period_start reporting_period_end"),
    (TEXT, "reporting_period_quarter"),
    (T.DecimalType(10, 2), "residents_per_day_reported"),
    (T.DecimalType(10, 4), "total_nurse_hprd_adj_reported total_nurse_hprd_reported"),
    (INT, "certified_beds_reported fines_count_reported"),
    (T.DecimalType(18, 2), "fines_usd_reported"),
    (INT, "payment_denials_reported penalties_reported"),
    (TIMESTAMP, "snapshot_received_ts"),
)

# Columns of the facility dimension, in order.
GOLD_FACILITY_DIM = table(
    (TEXT, "ccn provider_name state city county ownership_type"),
    (T.DecimalType(9, 4), "latitude longitude"),
)

FILE_ARRIVALS = table((TEXT, "dataset s3_path"), (TIMESTAMP, "modified first_seen_ts"))
FILE_FINISHES = table((TEXT, "s3_path"), (TIMESTAMP, "processed_ts"))
FILE_LOG = table(
    (TEXT, "dataset s3_path"), (TIMESTAMP, "first_seen_ts"),
    (TEXT, "status"), (TIMESTAMP, "processed_ts"),
)

# The ledger's snapshot; the last two columns are folders.
FILE_SNAPSHOT = table(
    (TEXT, "dataset s3_path"), (TIMESTAMP, "modified first_seen_ts processed_ts"),
    (TEXT, "status"), (DATE, "day"),
)

# Numbers of facilities, and bitmaps of them by state and month.
FACILITY_NUMBERS = table((TEXT, "ccn"), (T.LongType(), "number"))
FACILITY_BITMAPS = table((DATE, "month"), (TEXT, "state"), (T.LongType(), "bucket"), (T.BinaryType(), "bits"))

# Facility months: all sums the views need.
FACILITY_MONTHS = table(
    (DATE, "month"),
    (TEXT, "state ccn"),
    (T.DecimalType(38, 2), "total_hours_direct rn_hours lpn_hours cna_hours emp_hours ctr_hours"),
    (T.LongType(), "resident_days"),
    (INT, "days resident_days_seen"),
    (DATE, "first_day last_day"),
)
