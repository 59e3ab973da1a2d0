"""Tables of fixed size by hash. Bit sets keep rows which cannot matter out of a shuffle.

They are built from what is looked for. With more keys they let more through, up to everything, and
never hold back a row that is wanted; an exact join follows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.store import stored

FILTER_WORDS = 1 << 17  # 64-bit words of a bit set: 1 MiB
_BITS = FILTER_WORDS * 64
ONCE = 1  # rarity of a bucket with a single entry


def bit_set(keys: DataFrame) -> Column:
    """A bit per hash (column ``hash``), as one array of ``FILTER_WORDS`` words."""
    bit = F.pmod("hash", F.lit(_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(63).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit as int))")
    words = words.groupBy("word").agg(F.bit_or(one).alias("value"))
    every = keys.sparkSession.range(FILTER_WORDS).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    row = filled.agg(F.array_sort(F.collect_list(F.struct("word", "value"))).alias("all"))
    return stored(row.select(F.col("all.value").alias("bits")), "bit-set").scalar()


def may_hold(bits: Column, hashed: Column) -> Column:
    """False only for hashes that the set was not built from."""
    bit = F.pmod(hashed, F.lit(_BITS))
    word = F.get(bits, F.shiftright(bit, 6).cast("int"))
    return F.call_function("getbit", word, bit.bitwiseAND(63).cast("int")) == 1


def rarity(hashes: DataFrame, bits: int) -> Column:
    """Array by hash bucket (``2 ** bits``) of the log-scaled number of rows (column ``hash``) in it."""
    size = 1 << bits
    counts = hashes.groupBy(F.pmod("hash", F.lit(size)).alias("bucket")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127), F.floor(F.log2("n") * 4) + ONCE)
    every = hashes.sparkSession.range(size).withColumnRenamed("id", "bucket")
    filled = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce(level, F.lit(0)).cast("tinyint").alias("level")
    )
    # Put together in two steps, so that the last one holds few and short rows.
    pieces = filled.groupBy(F.shiftright("bucket", 11).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "level")))["level"].alias("levels")
    )
    row = pieces.agg(F.array_sort(F.collect_list(F.struct("piece", "levels"))).alias("all"))
    return stored(row.select(F.flatten("all.levels").alias("levels")), "rarity").scalar()


def holds(bits: np.ndarray, size: int, keys: np.ndarray) -> np.ndarray:
    """Which 64-bit keys a set of ``2 ** size`` bits (as bytes, lowest bit first) may hold.

    The place of a key is its highest ``size`` bits.
    """
    place = (keys >> np.uint64(64 - size)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
