"""Keyed upsert of one frame into another, with the null rules of SQL MERGE."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_TARGET = "_in_target"
_SOURCE = "_in_source"
_SPREAD = "_spread"


def all_present(keys: list[str]) -> Column:
    return reduce(and_, (F.col(key).isNotNull() for key in keys))


def unique_by(df: DataFrame, keys: list[str], *also: str) -> DataFrame:
    """The same rows; the job fails at the second row of any key that is wholly present.

    The check shares its shuffle and sort with the join that follows it, which may have further
    columns (``also``) among its keys. It stops at the second row, so a key with very many copies
    is not gathered.
    """
    by_key = Window.partitionBy(*keys, *also).orderBy(*keys)
    message = F.concat(
        F.lit("more than one source row for key "),
        F.concat_ws(", ", *(F.col(key).cast("string") for key in keys)),
    )
    fine = (F.col("_nth") == 1) | ~all_present(keys)
    checked = F.when(fine, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return df.withColumn("_nth", F.row_number().over(by_key)).where(checked).drop("_nth")


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update: list[str] | None = None,
    keep_old_when_null: bool = False,
    on_null_key: str = "insert",
    partitions: int = 0,
) -> DataFrame:
    """``target`` after merging ``source`` into it, as a lazy frame.

    Matched rows take the ``update`` columns from the source (all that are not
    keys by default), or only its non-NULL values with ``keep_old_when_null``.
    Unmatched source rows are inserted by column name. A row with a NULL in its
    key never matches: such target rows stay, such source rows are inserted or,
    with ``on_null_key="reject"``, left out.

    ``partitions`` says that the target is stored in so many buckets by hash of the keys, which its
    rows have in full: then only the source is shuffled, to the same buckets.
    """
    if on_null_key not in ("insert", "reject"):
        raise ValueError(f"on_null_key must be 'insert' or 'reject', not {on_null_key!r}")
    values = [name for name in target.columns if name not in keys]
    given = set(source.columns)
    changed = set(values if update is None else update) & given

    if on_null_key == "reject":
        source = source.where(all_present(keys))
    elif partitions:
        raise ValueError("rows without a key have no bucket; reject them")
    types = {field.name: field.dataType for field in target.schema}

    # Rows without a full key cannot match. They go through the same join, so that each input is
    # read once, but with a value of their own beside the key, which deals them out over the tasks.
    def spread(df: DataFrame) -> Column:
        return F.when(~all_present(keys), F.xxhash64(*df.columns)).otherwise(F.lit(0))

    on = keys if partitions else [*keys, _SPREAD]
    if partitions:
        source = source.withColumns({key: F.col(key).cast(types[key]) for key in keys})
        source = unique_by(source.repartition(partitions, *keys), keys)
    else:
        target = target.withColumn(_SPREAD, spread(target))
        source = unique_by(source.withColumn(_SPREAD, spread(source)), keys, _SPREAD)
    old = target.select(
        *on, *(F.col(name).alias(f"_old_{name}") for name in values),
        F.lit(True).alias(_TARGET),
    )
    new = source.select(
        *on, *(F.col(name).alias(f"_new_{name}") for name in values if name in given),
        F.lit(True).alias(_SOURCE),
    )

    def merged(name: str) -> Column:
        before = F.col(f"_old_{name}")
        if name not in given:
            return before
        arriving = F.col(f"_new_{name}")
        if name not in changed:
            after = before
        elif keep_old_when_null:
            after = F.coalesce(arriving, before)
        else:
            after = arriving
        return (
            F.when(F.col(_SOURCE).isNull(), before)
            .when(F.col(_TARGET).isNull(), arriving)
            .otherwise(after)
        )

    return old.join(new, on, "full_outer").select(
        *(
            (F.col(name) if name in keys else merged(name)).cast(kind).alias(name)
            for name, kind in types.items()
        )
    )
