"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

All rows are put into one fixed order (id, then checksum and hash of the text), which gives each a
global number 0 .. n - 1. A keyed Feistel network permutes the smallest domain of an even number
of bits that holds n; numbers that leave the range are permuted again until they come back (cycle
walking), which makes it a permutation of exactly 0 .. n - 1. Place ``p`` of the shuffle is slot
``p // shards`` of shard ``p % shards``: shard sizes differ by one row at most (the law is
``rows``), slots have no gaps, and both follow from the row number, the row count and the seed
alone. ``row_number_at`` inverts it: which row lies in a given shard and slot.

The order is a range partitioning of narrow rows. Numbers are the place within a partition plus
the sizes of those before, one small count per partition; no row set is gathered anywhere. Equal
rows share a range partition only as far as their spread allows: the last sort key tells copies
apart, and as such rows are equal, any order among them gives the same result.

Defined cases: a null text has size 1 and checksum 0; null and repeated ids are rows of their own;
an empty table gives no rows; extra columns are kept by ``sharded``, but for ``shard`` and ``slot``, and
ignored by ``assign``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.store import stored
from wardlake.llm.text import mix

SHARDS = 8
SEED = 20240401
ROUNDS = 6


class Feistel:
    """Permutation of 0 .. n - 1 that needs no memory."""

    def __init__(self, n: int, seed: int = SEED):
        self.n = n
        self.half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        keys = np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS)
        self.keys = mix(keys)

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix(right ^ key) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1]:
            left, right = right ^ (mix(left ^ key) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x).astype(np.uint64))
        while (outside := np.flatnonzero(x >= self.n)).size:
            x[outside] = step(x[outside])
        return x.astype(np.int64)

    def place(self, number: np.ndarray) -> np.ndarray:
        """Place in the shuffle of each row number."""
        return self._walk(number, self._once)

    def number(self, place: np.ndarray) -> np.ndarray:
        """Row number at each place of the shuffle."""
        return self._walk(place, self._back)


def row_number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """Global row number of the row in a shard's slot."""
    return int(Feistel(n, seed).number(np.array([slot * shards + shard]))[0])


def _permuted(number: Column, n: int, seed: int) -> Column:
    permutation = Feistel(n, seed)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permutation.place(numbers.to_numpy()))

    return place(number)


def numbered(rows: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """Rows with their global ``number`` in the given order, and how many there are."""
    spread = F.monotonically_increasing_id()
    ordered = rows.withColumn("_spread", spread).repartitionByRange(*order, "_spread")
    ordered = ordered.sortWithinPartitions(*order, "_spread").drop("_spread")
    # The id holds the partition in its upper bits and the place within it below.
    ordered = stored(ordered.withColumn("_id", F.monotonically_increasing_id()), "ordered-rows")
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(
        "_part", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_begin")
    )
    begins = stored(begins, "row-counts")
    total = begins.agg(F.sum("rows")).first()[0] or 0
    result = ordered.withColumn("_part", part).join(begins.drop("rows"), "_part")
    return result.withColumn("number", F.col("_begin") + place).drop("_part", "_begin", "_id"), total


def _assigned(rows: DataFrame, shards: int, seed: int, *also: str) -> DataFrame:
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "text_hash", *also]
    rows, total = numbered(rows, *order)
    rows = rows.withColumn("place", _permuted(F.col("number"), total, seed))
    return rows.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn(
        "slot", F.floor(F.col("place") / shards).cast("long")
    )


def _narrow(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        *more,
    )


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard and slot of every row of ``docs``; the law held is ``rows``."""
    rows = _assigned(_narrow(docs), shards, seed)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "number",
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with their ``shard`` and ``slot``.

    Columns of ``docs`` with these two names are left out for the new ones. Rows equal in id and text are
    ordered by a hash of all their columns, so reruns agree; only rows equal in all are told apart
    by their number among equals.
    """
    keyed = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    keyed = keyed.withColumn("row_hash", F.xxhash64(F.to_json("row")))
    rows = _assigned(_narrow(keyed, "row", "row_hash"), shards, seed, "row_hash")
    kept = [F.col("row").getField(name).alias(name) for name in docs.columns if name.lower() not in ("shard", "slot")]
    return rows.select(*kept, "shard", "slot")
