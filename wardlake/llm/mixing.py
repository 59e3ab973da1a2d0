"""Mixing sources to target weights by hash-threshold histograms.

Every document has one hash. Of a source whose target is ``k`` whole copies and a rest, every
document is taken ``k`` times, and once more if its hash lies below the source's threshold. The
threshold is found without sorting: sizes are summed by source and hash bucket, the running sum
shows the bucket in which the budget ends, and only the documents of that bucket are summed again
by finer buckets. As all budgets of a source use the same hash, smaller ones are subsets of larger
ones, and reruns agree.

Only DataFrame functions are used. Shuffles carry one row per (source, bucket); windows run over
the buckets of one source (at most ``2 ** BITS``) and over the list of sources.

Defined cases: null texts have size 0 and are taken 0 words; a null source is a source of its own,
last in order; null or repeated ids are documents of their own (the hash also covers the text, so
only wholly equal rows stay together); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.store import stored

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BITS = 10  # hash bits told apart by one histogram
LEVELS = 4  # a threshold is exact to 2 ** -(BITS * LEVELS) of the hash range


def n_words(text: Column) -> Column:
    """Runs of characters other than blank and ASCII control spaces."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """Target of each source (one row each: ``source``, ``source_size``).

    The targets share the sum of all sizes by weight, the weights repeating over the sources in
    code-point order. A target above ``cap`` times its source's size stops there and the excess is
    shared again by weight: all other targets are ``weight * level`` for one level. Sources with
    the smallest size per weight stop first, so the level follows from running sums in that order.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    wave = F.element_at(
        F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int")
    )
    by_limit = Window.orderBy((F.col("source_size") * cap / F.col("weight")), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap) / F.sum(
        "weight"
    ).over(onward)
    limit = F.col("source_size") * cap
    return (
        sizes.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", wave)
        # The level if this source and all later ones do not stop.
        .withColumn("level", level)
        .withColumn("stops", F.col("weight") * F.col("level") > limit)
        .withColumn("level", F.max(F.when(~F.col("stops"), F.col("level"))).over(Window.partitionBy()))
        .withColumn(
            "target",
            F.when(F.col("stops") | F.col("level").isNull(), limit.cast("double"))
            .otherwise(F.col("weight") * F.col("level")),
        )
        .select("source", "source_size", "target")
    )


def _top(bits: int) -> Column:
    """The first bits of the hash."""
    return F.shiftrightunsigned("hash", 64 - bits)


def _same_source(left: str, right: str) -> Column:
    return F.col(f"{left}.source").eqNullSafe(F.col(f"{right}.source"))


def thresholds(items: DataFrame, budgets: DataFrame) -> DataFrame:
    """Hash prefix per source below which items sum up to the budget.

    ``items`` has ``source``, ``size`` and ``hash``; ``budgets`` one row per source with ``source``
    and ``budget``. An item is chosen if the top ``BITS * LEVELS`` bits of its hash lie below
    ``prefix``. Items of the last boundary's prefix (as a rule one document) are chosen if that
    brings the sum nearer to the budget.
    """
    state = stored(budgets.select("source", F.col("budget").cast("double").alias("left"),
                                  F.lit(0).cast("long").alias("prefix")), "mix-state")
    for level in range(LEVELS):
        inside = items.alias("i").join(state.alias("t"), _same_source("i", "t"))
        if level:
            inside = inside.where(_top(BITS * level) == F.col("prefix"))
        bucket = _top(BITS * (level + 1)).bitwiseAND(2**BITS - 1)
        sums = inside.groupBy("i.source", "left", bucket.alias("bucket")).agg(
            F.sum("size").alias("size")
        )
        running = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("upto", F.sum("size").over(running))
        over = F.col("upto") > F.col("left")
        edges = sums.groupBy("source").agg(
            F.max(F.when(~over, F.col("upto"))).alias("used"),
            F.min(F.when(over, F.col("bucket"))).alias("edge"),
            F.min(F.when(over, F.col("upto"))).alias("edge_upto"),
        )
        used = F.coalesce("used", F.lit(0))
        nearer = F.col("edge_upto") - F.col("left") < F.col("left") - used
        step = F.coalesce(F.col("edge"), F.lit(2**BITS))
        if level == LEVELS - 1:
            step = F.when(F.col("edge").isNotNull() & nearer, step + 1).otherwise(step)
        state = stored(
            state.alias("t").join(edges.alias("e"), _same_source("t", "e"), "left").select(
                F.col("t.source").alias("source"),
                (F.col("left") - used).alias("left"),
                (F.col("prefix") * 2**BITS + step).cast("long").alias("prefix"),
            ),
            "mix-state",
        )
    return state.select("source", "prefix")


def mixing_plan(
    items: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEAT
) -> DataFrame:
    """Per source: size, target, whole copies of every document, and the prefix for one more."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = stored(targets(sizes, weights, cap), "mix-targets")
    ratio = F.try_divide("target", "source_size")
    copies = F.least(F.coalesce(F.floor(ratio), F.lit(0)), F.lit(cap)).cast("int")
    wanted = wanted.withColumn("copies", copies)
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    edge = thresholds(items, wanted.select("source", rest.alias("budget")))
    plan = wanted.alias("w").join(edge.alias("x"), _same_source("w", "x")).select(
        F.col("w.source").alias("source"), "source_size", "target", "copies", "prefix"
    )
    return stored(plan, "mix-plan")


def _times(cap: int) -> Column:
    extra = (_top(BITS * LEVELS) < F.col("prefix")).cast("int")
    return F.least(F.col("copies") + extra, F.lit(cap))


def _hash() -> Column:
    return F.xxhash64("doc_id", "text")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """Per document: size, its source's size and target, the words the mix takes from it, and how often."""
    items = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash().alias("hash"))
    items = stored(items, "mix-items")
    plan = mixing_plan(items, weights, cap)
    return items.alias("i").join(plan.alias("p"), _same_source("i", "p")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times(cap)).alias("taken"),
        _times(cap).alias("times"),
    )


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, texts without words like all others.

    All columns of ``docs`` are kept, whatever their names are.
    """
    items = docs.select("source", n_words(F.col("text")).alias("size"), _hash().alias("hash"))
    plan = mixing_plan(stored(items, "mix-items"), weights, cap)
    whole = docs.select(F.struct("*").alias("row"), "source", _hash().alias("hash"),
                        n_words(F.col("text")).alias("size"))
    chosen = whole.alias("i").join(plan.alias("p"), _same_source("i", "p"))
    repeated = chosen.select("row", F.explode(F.array_repeat(F.lit(True), _times(cap))))
    return repeated.select("row.*")
