"""Words of text columns as numpy arrays, for use inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A word is a run of digits, letters a-z (A-Z lower-cased) and anything outside ASCII, that is
# every match of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in the lower-cased text. In UTF-8 all bytes of
# a character outside ASCII are 0x80 or above, so bytes can be classed one by one.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BYTE_VALUES = np.random.default_rng(20240401).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


_KEPT = 1 << 22  # powers that a worker keeps of each base: 32 MiB
_POWERS: dict[int, np.ndarray] = {}


def _steps(base: int, size: int) -> np.ndarray:
    steps = np.full(size, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(base: np.uint64, size: int) -> np.ndarray:
    """``base ** 0 .. base ** (size - 1)`` modulo 2**64; a bounded number of them is kept."""
    if size > _KEPT:
        return _steps(int(base), size)
    kept = _POWERS.get(int(base))
    if kept is None or len(kept) < size:
        kept = _POWERS[int(base)] = _steps(int(base), 1 << max(10, int(size - 1).bit_length()))
    return kept[:size]


def give_back() -> None:
    """Return memory that a worker no longer uses to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


@dataclass
class Words:
    """Words of some consecutive texts: byte ranges in ``data``, hashes, and each text's range."""

    data: np.ndarray  # lower-cased UTF-8 bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    text_ends: np.ndarray  # word count up to and with each text

    def names(self, at: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words at these places, concatenated, and where each ends."""
        starts, ends = self.starts[at], self.ends[at]
        sizes = ends - starts
        name_ends = np.cumsum(sizes)
        places = np.arange(int(sizes.sum())) + np.repeat(starts - (name_ends - sizes), sizes)
        return self.data[places].tobytes(), name_ends


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the boundaries of its texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def words(texts: pa.Array) -> Words:
    """All words of all texts of an array."""
    raw, bounds = text_bytes(texts)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(raw, none, none, none.astype(np.uint64), np.zeros(len(texts), np.int64))
    inside = _IS_WORD[raw]
    edge = np.empty(len(raw) + 1, bool)  # whether a word may begin or end before this byte
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    data = _LOWER[raw]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data))[starts]
    return Words(data, starts, ends, mix(hashes), np.searchsorted(starts, bounds[1:], "left"))


def cuts(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Begin and length of parts with at most ``limit`` bytes of text each, but for single rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    totals, begin = np.cumsum(sizes), 0
    while begin < len(totals):
        before = totals[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(totals, before + limit, "right")))
        yield begin, end - begin
        begin = end


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each, but for single rows."""
    for begin, size in cuts(batch.column(batch.schema.get_field_index(text)), limit):
        yield batch.slice(begin, size)
