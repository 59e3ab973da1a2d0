"""Hand-written gold rows whose results can be checked by eye."""

from datetime import date
from decimal import Decimal

from wardlake.plans.views import Gold
from wardlake.schemas import GOLD_DAILY, GOLD_FACILITY_DIM, GOLD_QUARTERLY


def day(workdate, state, ccn, rn=None, lpn=None, cna=None, residents=None, ctr=None):
    """One fact row; all hours are employee hours except ``ctr`` RN hours."""
    def money(value):
        return None if value is None else Decimal(value)

    direct = Decimal(sum(value or 0 for value in (rn, lpn, cna)))
    rn_emp = None if rn is None else Decimal(rn - (ctr or 0))
    return (
        date.fromisoformat(workdate), state, ccn, money(rn), money(lpn), money(cna), direct,
        rn_emp, money(ctr), money(lpn), None, money(cna), None, residents,
    )


def beds(ccn, state, count, quarter="2024Q2"):
    return (ccn, state, None, None, quarter, None, None, None, count, None, None, None, None, None)


def facility(ccn, name, state, lat=None, lon=None):
    def place(value):
        return None if value is None else Decimal(str(value))

    return (ccn, name, state, None, None, None, place(lat), place(lon))


def gold(spark, days, quarterly=(), facilities=()):
    return Gold(
        spark.createDataFrame(list(days), GOLD_DAILY),
        spark.createDataFrame(list(quarterly), GOLD_QUARTERLY),
        spark.createDataFrame(list(facilities), GOLD_FACILITY_DIM),
    )
