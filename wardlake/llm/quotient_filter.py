"""Exact deduplication with counting quotient filters.

Every partition puts the 64-bit fingerprints of its texts into counting quotient filters, one per
slice of the fingerprint space. A filter splits a fingerprint into quotient and remainder, keeps
the remainders of a quotient as a sorted run with counters, and marks occupied quotients and run
ends in two bit vectors. As remainders are kept whole and sorted, filters of the same slice merge
losslessly like sorted lists. Copies within a partition meet in one counter before any shuffle, so
a text that is a third of the corpus costs one entry per partition.

Texts whose fingerprint has count 1 are unique: equal texts have equal fingerprints. All others are
routed to verification, where whole normalised texts are grouped byte by byte.

Defined cases: null counts as the empty text; white space is ``[\\x20\\x09-\\x0D]``; of equal texts the
row with the most code points, then with the smallest id stays, a null id after all others; rows
equal in id and text are all kept or dropped alike with ``keep_id`` the same; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.store import stored

SLICE_BITS = 10  # first bits of a fingerprint: its filter
QUOTIENT_BITS = 14  # at most; next bits: its quotient; the rest is the remainder
SALTS = 16


@dataclass
class CountingQuotientFilter:
    """Multiset of fingerprints of ``bits`` bits, kept as sorted remainders per quotient."""

    bits: int
    quotient_bits: int
    occupied: np.ndarray  # bool per quotient: it has a run
    run_end: np.ndarray  # bool per entry: the last of its run
    remainders: np.ndarray  # sorted within each run
    counts: np.ndarray

    @classmethod
    def of(cls, prints: np.ndarray, bits: int, counts: np.ndarray | None = None):
        """Filter of fingerprints (repeats allowed), each counted once or as given."""
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        begins = np.flatnonzero(np.diff(prints, prepend=prints[:1] ^ np.uint64(1)) != 0)
        counts = np.add.reduceat(counts, begins) if len(begins) else counts
        prints = prints[begins]
        quotient_bits = min(QUOTIENT_BITS, bits, max(1, int(len(prints)).bit_length()))
        rest = np.uint64(bits - quotient_bits)
        quotients = (prints >> rest).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        run_end = np.ones(len(prints), bool)
        run_end[:-1] = quotients[1:] != quotients[:-1]
        remainders = prints & np.uint64((1 << int(rest)) - 1)
        return cls(bits, quotient_bits, occupied, run_end, remainders, counts)

    def prints(self) -> np.ndarray:
        """The distinct fingerprints in order."""
        run = np.cumsum(self.run_end) - self.run_end
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)
        high = quotients[run] if len(run) else np.zeros(0, np.uint64)
        return (high << np.uint64(self.bits - self.quotient_bits)) | self.remainders

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The filter of both multisets; nothing is lost, whatever their quotient sizes."""
        prints = np.concatenate([self.prints(), other.prints()])
        return self.of(prints, self.bits, np.concatenate([self.counts, other.counts]))

    def count(self, prints: np.ndarray) -> np.ndarray:
        """How often each of the given fingerprints was put in."""
        own = self.prints()
        if not len(own):
            return np.zeros(len(prints), np.int64)
        at = np.minimum(np.searchsorted(own, prints), len(own) - 1)
        return np.where(own[at] == prints, self.counts[at], 0)

    def dump(self) -> bytes:
        """Header, bit vectors, remainders of whole bytes, then counters above one with places."""
        width = -(-(self.bits - self.quotient_bits) // 8)
        low = self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        more = np.flatnonzero(self.counts > 1)
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), len(more)], "<i8")
        parts = [head, np.packbits(self.occupied), np.packbits(self.run_end), low,
                 more.astype("<i8"), self.counts[more].astype("<i8")]
        return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)

    @classmethod
    def load(cls, raw: bytes) -> CountingQuotientFilter:
        bits, quotient_bits, n, n_more = np.frombuffer(raw, "<i8", 4).tolist()
        at, width = 32, -(-(bits - quotient_bits) // 8)

        def take(size: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, np.uint8, size, at)
            at += size
            return part

        occupied = np.unpackbits(take(-(-(1 << quotient_bits) // 8)))[:1 << quotient_bits]
        run_end = np.unpackbits(take(-(-n // 8)))[:n]
        low = np.zeros((n, 8), np.uint8)
        low[:, :width] = take(n * width).reshape(n, width)
        more = take(8 * n_more).view("<i8") if n_more else np.zeros(0, np.int64)
        counts = np.ones(n, np.int64)
        if n_more:
            counts[more] = take(8 * n_more).view("<i8")
        return cls(bits, quotient_bits, occupied.astype(bool), run_end.astype(bool),
                   low.reshape(-1).view("<u8").astype(np.uint64), counts)


def _filters(fingerprints: DataFrame, slice_bits: int) -> DataFrame:
    """Filters of each partition by slice."""
    bits = 64 - slice_bits

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, CountingQuotientFilter] = {}
        for batch in batches:
            prints = batch["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
            own = (prints >> np.uint64(bits)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[order])) + 1
            for part in np.split(order, edges) if len(order) else ():
                low = prints[part] & np.uint64((1 << bits) - 1)
                new = CountingQuotientFilter.of(low, bits)
                old = kept.get(int(own[part[0]]))
                kept[int(own[part[0]])] = old.merge(new) if old else new
        for number, each in kept.items():
            yield pd.DataFrame({"slice": [number], "filter": [each.dump()]})

    return fingerprints.mapInPandas(build, "slice long, filter binary")


def repeated_fingerprints(fingerprints: DataFrame, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Fingerprints counted more than once, with their counts (``fingerprint``, ``copies``)."""
    bits = 64 - slice_bits

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Pairs of neighbours, then pairs of results, so that each entry is merged log2 times.
        parts = [CountingQuotientFilter.load(raw) for raw in group["filter"]]
        while len(parts) > 1:
            parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1:]
        many = parts[0].counts > 1
        prints = parts[0].prints()[many] | (np.uint64(key[0]) << np.uint64(bits))
        return pd.DataFrame({"fingerprint": prints.view(np.int64), "copies": parts[0].counts[many]})

    filters = _filters(fingerprints.select("fingerprint"), slice_bits)
    return filters.groupBy("slice").applyInPandas(merge, "fingerprint long, copies long")


def normalised(text: Column) -> Column:
    """The text without white space."""
    text = F.coalesce(text, F.lit(""))
    for space in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def exact_duplicates(docs: DataFrame, slice_bits: int = SLICE_BITS) -> DataFrame:
    """Per row: the id that stays for its text, the number of equal texts, and whether it stays."""
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.char_length(text).alias("chars"), normalised(F.col("text")).alias("norm"))
    rows = stored(
        plain.select(
            "doc_id", "chars", F.xxhash64("norm").alias("fingerprint"),
            F.sha2("norm", 256).alias("text_sha256"),
        ),
        "fingerprints",
    )
    many = stored(repeated_fingerprints(rows, slice_bits), "repeated")
    # Byte verification: the grouping key is the whole normalised text.
    suspects = plain.withColumn("fingerprint", F.xxhash64("norm")).join(many, "fingerprint", "left_semi")
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    groups = suspects.groupBy("norm").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.where("group_size > 1").select(
        F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.chars")).alias("keep_chars"), "group_size",
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(groups, ["text_sha256", "salt"], "left")
    alone = F.col("group_size").isNull()
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | stays).alias("kept"),
        "text_sha256",
    )
