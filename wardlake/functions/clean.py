"""Text cleaning, facility keys and safe casts for the raw string layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_LENGTH = 6


def text(name: str) -> Column:
    return F.trim(F.col(name))


def upper_text(name: str) -> Column:
    return F.upper(text(name))


def ccn_pbj(name: str) -> Column:
    """Key of the daily files: trimmed and zero-padded; letters survive, extra characters go.

    A blank cell is no key at all, so it stays NULL instead of becoming zeros.
    """
    return F.lpad(F.nullif(text(name), F.lit("")), KEY_LENGTH, "0")


def ccn_provider(name: str) -> Column:
    """Key of the provider files: the rightmost six digits, zero-padded; NULL without digits."""
    digits = F.nullif(F.regexp_replace(text(name), "[^0-9]", ""), F.lit(""))
    return F.lpad(F.right(digits, F.lit(KEY_LENGTH)), KEY_LENGTH, "0")


def safe(name: str, type_name: str) -> Column:
    """Cast, or NULL when the text does not parse."""
    return F.col(name).try_cast(type_name)


def safe_date(name: str) -> Column:
    """Dates written either as 2024-04-01 or as 20240401; NULL otherwise."""
    raw = text(name)
    return F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), F.try_to_date(raw, "yyyyMMdd"))


def _coerce(df: DataFrame, names: list[str], type_name: str) -> DataFrame:
    present = [name for name in names if name in df.columns]
    return df.withColumns({name: F.col(name).try_cast(type_name) for name in present})


def coerce_numeric(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn the named columns that exist into doubles, unparsable values into NULL."""
    return _coerce(df, names, "double")


# Written forms of a date that are tried one after the other, after Spark's own cast.
DATE_FORMS = ("yyyyMMdd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd", "dd-MMM-yyyy")


def any_timestamp(name: str) -> Column:
    """The time a text stands for, in the first form that reads it; NULL when none does.

    Runs of eight digits are dates and not years, so the compact form comes before the cast.
    """
    raw = text(name)
    forms = [F.try_to_timestamp(raw, F.lit(form)) for form in DATE_FORMS]
    compact = F.when(raw.rlike("^[0-9]{8}$"), forms[0])
    plain = F.when(~raw.rlike("^[0-9]+$"), raw.try_cast("timestamp"))
    return F.coalesce(compact, plain, *forms[1:])


def coerce_datetime(df: DataFrame, names: list[str]) -> DataFrame:
    """Turn the named columns that exist into timestamps, unparsable values into NULL.

    Texts may be written in any of the common forms, also mixed within a column.
    """
    present = [name for name in names if name in df.columns]
    kinds = dict(df.dtypes)
    return df.withColumns({
        name: any_timestamp(name) if kinds[name] == "string" else F.col(name).try_cast("timestamp")
        for name in present
    })
