"""Removal of repeated byte strings by prefix-free parsing and suffix order.

Every byte that lies in a string of ``length`` bytes (100) which also starts earlier in the corpus is
removed; earlier means a smaller document id or, in the same document, an earlier start.

*Parse.* A rolling hash over ``WIDTH`` bytes is taken at every byte. The leftmost smallest hash within
a string of ``length`` bytes is its trigger, so equal strings have their triggers at the same place
wherever they stand. All neighbouring strings with one trigger form a phrase; phrases
overlap by ``length - 1`` bytes, hence each string lies whole in one phrase, that of its trigger,
and equal strings can only lie in phrases of equal triggers.

*Dictionary.* Triggers are counted over the corpus (sorted runs of counted triggers, merged by
slices of the hash space), with a print of their phrase as long as they have only one. Phrases of a
trigger that occurs once cannot hold a repeated string and never leave their task. The places of the others are
shuffled by trigger, each distinct phrase once per task; their bytes go along only where a
trigger has several phrases. Later places of a phrase are removed whole.

*Suffix order.* Per trigger the distinct phrases are the dictionary and their places in the corpus
the parse. The suffixes of the distinct phrases are
sorted by prefix doubling (8, 16, 32, 64, then ``length`` bytes); suffixes that agree on all
``length`` bytes are neighbours in that order, and all but the first place in the corpus are removed.
As phrases overlap, no suffix has to be compared beyond its phrase.

A trigger with very many different phrases (``HOT``) would make one large group. Its strings are dealt
out one by one instead, by a hash of the whole string together with the trigger's, so such a group spreads over
all tasks; each task sends a string once. Both ways give the same result.

The driver holds three bit sets of at most 16, 16 and 2 MiB, whatever the corpus. With more repeated
triggers than they can tell apart, more phrases are shuffled; the result stays the same.

Defined cases: null counts as the empty text; texts shorter than ``length`` are kept whole; a null
id comes after all others; rows with equal ids are ordered by a hash of their texts; of rows equal in
id and text one stays as it is, and the others are removed whole if they have ``length`` bytes; extra
columns are ignored; an empty table gives no rows. Very long texts are parsed piece by piece.
Phrases are taken as equal within a task if two 64-bit hashes agree, those of a trigger without a second
phrase by 48 bits each of its and of their hash, all others by all their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.bits import holds
from wardlake.llm.store import stored
from wardlake.llm.text import (
    _BASE, _BASE_INVERSE, _BYTE_VALUES, cuts, mix, powers, text_bytes,
)

LENGTH = 100
WIDTH = 32
HOT = 4096  # different phrases of a trigger, above which its strings are dealt out one by one
PIECE = 1 << 19  # bytes parsed at a time
SLICE_BYTES = 4 << 20  # text per slice of the hash space
SEEN = 1 << 20  # phrases that a task remembers
RUN = 1 << 21  # triggers that a task counts before it sends them on
MOST_BITS = 27
KEY_BITS = 48

PHRASE, SPAN, STRING, WHOLE = 0, 1, 2, 3
PLACE = ("no_id", "id", "h", "start")
_ROWS = pa.schema([
    ("kind", pa.int32()), ("key", pa.int64()), ("no_id", pa.int32()), ("id", pa.int64()),
    ("h", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("phrase", pa.binary()),
])
ROWS = "kind int, key long, no_id int, id long, h long, start long, stop long, phrase binary"
SETS = ("repeated", "several", "hot")
SPANS = "no_id int, id long, h long, start long, stop long"


@dataclass
class Phrases:
    """Phrases of some texts: first and last string start, hashes of the trigger and of all bytes."""

    first: np.ndarray
    last: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray
    strings: np.ndarray  # hash of the string of ``length`` bytes at each place


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` neighbouring values."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def parse(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, width: int = WIDTH) -> Phrases:
    """Phrases of consecutive texts (``bounds``) of fewer than 2**24 bytes."""
    size = len(data)
    none = np.zeros(0, np.int64)
    if size < length:
        return Phrases(none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(np.uint64))
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, size), out=sums[1:])
    back = powers(_BASE_INVERSE, size)
    rolling = mix((sums[width:] - sums[:-width]) * back[:size - width + 1])
    low = np.uint64((1 << 24) - 1)
    ranked = (rolling & ~low) | np.arange(len(rolling), dtype=np.uint64)
    place = (_least(ranked, length - width + 1) & low).astype(np.int64)
    # Strings that would run over the end of their text do not count.
    ends = np.maximum(bounds[1:] - (length - 1), bounds[:-1])
    change = np.zeros(size + 1, np.int32)
    np.add.at(change, ends, 1)
    np.add.at(change, bounds[1:], -1)
    inside = np.cumsum(change[:len(place)]) == 0
    edge = np.flatnonzero(np.diff(place)) + 1
    cut = np.zeros(len(place) + 1, bool)
    cut[edge] = cut[0] = cut[-1] = True
    cut[1:-1] |= inside[1:] != inside[:-1]
    starts = np.flatnonzero(cut)
    first, last = starts[:-1], starts[1:] - 1
    first, last = first[inside[first]], last[inside[first]]
    trigger = rolling[place[first]]
    phrase = mix((sums[last + length] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    strings = (sums[length:] - sums[:-length]) * back[:size - length + 1]
    return Phrases(first, last, trigger, phrase, strings)


def _pieces(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds, row numbers and offsets of parts of about ``PIECE`` bytes.

    A longer text comes in parts that overlap by ``length - 1`` bytes, so each string lies in one.
    """
    texts = batch.column("text")
    for begin, count in cuts(texts, PIECE):
        data, bounds = text_bytes(texts.slice(begin, count))
        rows = np.arange(begin, begin + count)
        if count > 1 or len(data) <= 2 * PIECE:
            yield data, bounds, rows, np.zeros(count, np.int64)
            continue
        for offset in range(0, len(data) - length + 1, PIECE):
            part = data[offset:offset + PIECE + length - 1]
            yield part, np.array([0, len(part)]), rows, np.array([offset])


# Counted triggers: keys, prints of their only phrase (0: several), numbers of phrases.
Counted = tuple[np.ndarray, np.ndarray, np.ndarray]


def _counted(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> Counted:
    """Distinct keys in order, with the print that all their entries share and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, prints, counts = keys[order], prints[order], counts[order]
    begins = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0)
    if not len(begins):
        return keys, prints, counts
    least, most = (each.reduceat(prints, begins) for each in (np.minimum, np.maximum))
    return keys[begins], np.where(least == most, least, np.uint64(0)), np.add.reduceat(counts, begins)


def _merged(parts: list[Counted]) -> Counted:
    return _counted(*(np.concatenate(side) for side in zip(*parts)))


_PLANES = KEY_BITS // 8


def _pack(keys: np.ndarray, prints: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: byte planes of keys and prints, then the counts above one with their places."""
    planes = [side.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_PLANES].T for side in (keys, prints)]
    more = np.flatnonzero(counts > 1)
    head = np.array([len(keys), len(more)], "<i8")
    return b"".join(np.ascontiguousarray(part).tobytes() for part in
                    (head, *planes, more.astype("<i4"), counts[more].astype("<i4")))


def _unpack(raw: bytes) -> Counted:
    n, m = np.frombuffer(raw, "<i8", 2).tolist()
    wide = np.zeros((2, n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8, 2 * n * _PLANES, 16).reshape(2, _PLANES, n)
    wide[:, :, :_PLANES] = planes.transpose(0, 2, 1)
    at = 16 + 2 * n * _PLANES
    counts = np.ones(n, np.int64)
    if m:
        counts[np.frombuffer(raw, "<i4", m, at)] = np.frombuffer(raw, "<i4", m, at + 4 * m)
    keys, prints = wide.view("<u8").reshape(2, n).astype(np.uint64)
    return keys, prints, counts


@dataclass(frozen=True)
class Sizes:
    """Slices of the hash space and bits of the two sets, by the bytes of the corpus."""

    slices: int
    repeated: int
    hot: int

    @classmethod
    def of(cls, size: int) -> Sizes:
        bits = max(0, math.ceil(math.log2(max(size, 1))))
        repeated = min(MOST_BITS, max(16, bits - 2))
        slices = min(repeated - 6, 20, max(3, bits - SLICE_BYTES.bit_length() + 1))
        return cls(slices, repeated, repeated - 3)


def _runs(sizes: Sizes, length: int):
    """Counted triggers of a task as sorted runs, one per slice."""
    shift = np.uint64(KEY_BITS - sizes.slices)

    def emit(counted: Counted) -> Iterator[pa.RecordBatch]:
        own = (counted[0] >> shift).astype(np.int64)
        edges = np.flatnonzero(np.diff(own)) + 1
        parts = list(zip(*(np.split(side, edges) for side in counted))) if len(own) else []
        names = [own[0], *own[edges]] if len(own) else []
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([_pack(*part) for part in parts], pa.binary())],
            ["slice", "run"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for data, bounds, _, _ in _pieces(batch, length):
                found = parse(data, bounds, length)
                order = np.lexsort((found.phrase, found.trigger))
                trigger, phrase = found.trigger[order], found.phrase[order]
                new = np.ones(len(order), bool)
                new[1:] = trigger[1:] != trigger[:-1]
                other = new.copy()
                other[1:] |= phrase[1:] != phrase[:-1]
                begins = np.flatnonzero(new)
                if not len(begins):
                    continue
                # Different phrases here, and two at least where the trigger occurs again.
                many = np.diff(begins, append=len(order)) > 1
                phrases = np.add.reduceat(other.astype(np.int64), begins)
                prints = np.maximum(phrase[begins] >> np.uint64(64 - KEY_BITS), np.uint64(1))
                kept.append((
                    trigger[begins] >> np.uint64(64 - KEY_BITS), np.where(phrases == 1, prints, np.uint64(0)),
                    np.maximum(phrases, 1 + many),
                ))
                size += len(begins)
                if size > RUN:
                    kept = [_merged(kept)]
                    size = len(kept[0][0])
                    if size > RUN // 2:
                        yield from emit(kept[0])
                        kept, size = [], 0
        if kept:
            yield from emit(_merged(kept))

    return count


def _bits(places: np.ndarray, size: int) -> bytes:
    marks = np.zeros(size, np.uint8)
    marks[places] = 1
    return np.packbits(marks, bitorder="little").tobytes()


def _sets(sizes: Sizes, hot: int):
    """Merges the runs of a slice into its part of the three bit sets."""

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        keys, prints, counts = _merged([_unpack(run) for run in group["run"]])
        several = (counts > 1) & (prints == 0)
        parts = []
        for bits, wanted in (
            (sizes.repeated, counts > 1), (sizes.repeated, several), (sizes.hot, several & (counts > hot))
        ):
            places = keys[wanted] >> np.uint64(KEY_BITS - bits)
            size = 1 << (bits - sizes.slices)
            parts.append(_bits((places & np.uint64(size - 1)).astype(np.int64), size))
        return pd.DataFrame({"slice": [key[0]], **{name: [part] for name, part in zip(SETS, parts)}})

    return merge


def _compare(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether places of ``one`` come before those of ``two``, and whether they are the same."""
    before, same = np.zeros(len(one[0]), bool), np.ones(len(one[0]), bool)
    for a, b in zip(one, two):
        before |= same & (a < b)
        same &= a == b
    return before, same


class Seen:
    """First places of the keys that a task has sent on; forgets them when they are too many."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = [np.zeros(0, np.int64) for _ in PLACE]

    def check(self, keys: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Masks of the keys to send on, and of those known to stand at an earlier place too.

        Keys whose place is already known (rows repeated whole) are in neither.
        """
        send, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        if not len(keys):
            return send, later
        order = np.lexsort((*reversed(places), keys))
        ranked = keys[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later[order] = _compare([p[first] for p in places], [p[order] for p in places])[0]
        firsts = order[new]
        at = np.searchsorted(self.keys, keys[firsts])
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[firsts[known]]
        old = [p[at[known]] for p in self.places]
        held = firsts[known]
        earlier, same = _compare([p[held] for p in places], old)
        send[firsts[~known]] = True
        send[held[earlier]] = True
        later[held] = ~earlier & ~same
        # What is later than the first of this batch stays later, whatever was known before.
        for kept, p in zip(self.places, places):
            kept[at[known][earlier]] = p[held[earlier]]
        if len(self.keys) + int((~known).sum()) > SEEN:
            self.__init__()
            return send, later
        added = firsts[~known]
        merged = np.concatenate([self.keys, keys[added]])
        order = np.argsort(merged, kind="stable")
        self.keys = merged[order]
        self.places = [np.concatenate([k, p[added]])[order] for k, p in zip(self.places, places)]
        return send, later


def _joined(group: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans within each group, joined where they touch."""
    order = np.lexsort((start, group))
    group, start, stop = group[order], start[order], stop[order]
    if not len(order):
        return group, start, stop
    # Ends so far, kept apart by group through an offset that grows with it.
    width = int(stop.max()) + 1
    rank = np.cumsum(np.diff(group, prepend=group[:1]) != 0)
    reach = np.maximum.accumulate(stop + rank * width)
    new = np.ones(len(order), bool)
    new[1:] = (rank[1:] != rank[:-1]) | (start[1:] + rank[1:] * width > reach[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(order)) - 1
    return group[begins], start[begins], reach[ends] - rank[ends] * width


def _take(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def _candidates(shared: dict, sizes: Sizes, length: int):
    """Phrases whose trigger may occur again, strings of hot triggers, and spans known to be repeats."""

    def rows(kind: int, key, places, stop, phrases=None) -> pa.RecordBatch:
        n = len(key)
        columns = [np.full(n, kind, np.int32), key.view(np.int64), places[0].astype(np.int32), *places[1:], stop]
        arrays = [pa.array(c) for c in columns]
        arrays.append(phrases if phrases is not None else pa.nulls(n, pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, schema=_ROWS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, several, often = (np.frombuffer(shared[name].value, np.uint8) for name in SETS)
        phrases_seen, strings_seen = Seen(), Seen()
        for batch in batches:
            names = [batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in PLACE[:3]]
            for data, bounds, numbers, offsets in _pieces(batch, length):
                found = parse(data, bounds, length)
                maybe = holds(some, sizes.repeated, found.trigger)
                many = maybe & holds(several, sizes.repeated, found.trigger)
                dealt = many & holds(often, sizes.hot, found.trigger)

                def places_of(starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
                    local = np.searchsorted(bounds, starts, "right") - 1
                    own = [name[numbers[local]] for name in names]
                    return local, [*own, starts - bounds[local] + offsets[local]]

                spans = []
                at = np.flatnonzero(maybe & ~dealt)
                local, places = places_of(found.first[at])
                stop = places[3] + found.last[at] - found.first[at] + length
                send, later = phrases_seen.check(mix(found.trigger[at] ^ mix(found.phrase[at])), places)
                spans.append((local[later], places[3][later], stop[later]))
                whole = send & ~many[at]
                yield rows(WHOLE, found.trigger[at[whole]], [p[whole] for p in places], stop[whole])
                send &= many[at]
                starts = found.first[at[send]]
                count = found.last[at[send]] - starts + length
                raw = _take(data, starts, count)
                ends = np.zeros(len(count) + 1, np.int32)
                np.cumsum(count, out=ends[1:])
                phrases = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield rows(PHRASE, found.trigger[at[send]], [p[send] for p in places], stop[send], phrases)

                at = np.flatnonzero(dealt)
                count = found.last[at] - found.first[at] + 1
                starts = _take(np.arange(len(data)), found.first[at], count)
                trigger = np.repeat(found.trigger[at], count)
                key = mix(found.strings[starts] ^ mix(trigger))
                local, places = places_of(starts)
                send, later = strings_seen.check(key, places)
                spans.append((local[later], places[3][later], places[3][later] + length))
                yield rows(STRING, key[send], [p[send] for p in places], trigger[send].view(np.int64))

                local, start, stop = _joined(*(np.concatenate(side) for side in zip(*spans)))
                own = [name[numbers[local]] for name in names]
                key = mix(own[2].view(np.uint64) + start.astype(np.uint64))
                yield rows(SPAN, key, [*own, start], stop)

    return find


def suffix_classes(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes at each start in suffix order; equal strings have equal ranks.

    Prefix doubling: the order of all suffixes by their first 8 bytes, then by 16, 32 and so on
    from pairs of ranks, and last by ``length`` bytes from two ranks that overlap.
    """
    def ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        out = np.empty(len(values), np.uint64)
        out[order] = np.cumsum(np.diff(values[order], prepend=values[order[:1]]) != 0)
        return out

    depth = min(8, 1 << (length.bit_length() - 1))
    padded = np.concatenate([data, np.zeros(2 * length, np.uint8)])
    values = np.zeros(len(data) + length, np.uint64)
    for at in range(depth):
        values = (values << np.uint64(8)) | padded[at:at + len(values)]
    rank = ranks(values)
    while 2 * depth <= length:
        rank = ranks((rank[:-depth] << np.uint64(32)) | rank[depth:])
        depth *= 2
    return ranks((rank[starts] << np.uint64(32)) | rank[starts + length - depth]).astype(np.int64)


def _firsts(group: np.ndarray, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per row the row with the first place of its group, and whether that place is an earlier one."""
    order = np.lexsort((*reversed(places), group))
    ranked = group[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first = np.empty(len(order), np.int64)
    if len(order):
        first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return first, _compare([p[first] for p in places], places)[0]


def _repeats(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Spans to remove among rows that hold all rows of their keys."""
    kind, key, stop = (batch.column(name).to_numpy() for name in ("kind", "key", "stop"))
    places = [batch.column(name).to_numpy().astype(np.int64) for name in PLACE]

    def spans(at: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        at, start, end = _joined(at, start, end)
        columns = [places[0][at].astype(np.int32), places[1][at], places[2][at], start, end]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in columns], ["no_id", "id", "h", "start", "stop"]
        )

    known = np.flatnonzero(kind == SPAN)
    yield spans(known, places[3][known], stop[known])

    at = np.flatnonzero(kind == STRING)
    order = np.lexsort((stop[at], key[at]))
    ranked = np.zeros(len(at), bool)
    ranked[1:] = (np.diff(key[at][order]) != 0) | (np.diff(stop[at][order]) != 0)
    group = np.empty(len(at), np.int64)
    group[order] = np.cumsum(ranked)
    later = at[_firsts(group, [p[at] for p in places])[1]]
    yield spans(later, places[3][later], places[3][later] + length)

    at = np.flatnonzero(kind == WHOLE)
    later = at[_firsts(key[at], [p[at] for p in places])[1]]
    yield spans(later, places[3][later], stop[later])

    # Dictionary: a phrase is its key and its bytes.
    at = np.flatnonzero(kind == PHRASE)
    if not len(at):
        return
    phrases = batch.column("phrase").take(pa.array(at))
    codes = phrases.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first, again = _firsts(codes, [p[at] for p in places])
    later = at[again]
    yield spans(later, places[3][later], stop[later])
    entry = np.flatnonzero(first == np.arange(len(at)))
    size = np.unique(key[at[entry]], return_inverse=True, return_counts=True)
    entry = entry[size[2][size[1]] > 1]
    if not len(entry):
        return

    # Suffix order over the distinct phrases of triggers that have more than one.
    data, bounds = _binary(phrases.take(pa.array(entry)))
    count = np.diff(bounds) - length + 1
    owner = np.repeat(np.arange(len(entry)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    classes = suffix_classes(data, bounds[owner] + inner, length)
    shared = np.flatnonzero(np.bincount(classes)[classes] > 1)
    owner, inner, classes = at[entry[owner[shared]]], inner[shared], classes[shared]
    own = [p[owner] for p in places]
    own[3] = own[3] + inner
    later = _firsts(classes, own)[1]
    yield spans(owner[later], own[3][later], own[3][later] + length)


def _binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data, (bounds - bounds[0]).astype(np.int64)


def _resolve(length: int):
    """Spans to remove from rows sorted by key; a key's rows may run over several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut == 0 and held and held[-1].column("key")[-1].as_py() == keys[0]:
                held.append(batch)
                continue
            yield from _repeats(pa.concat_batches([*held, batch.slice(0, cut)]), length)
            held = [batch.slice(cut)]
        if held:
            yield from _repeats(pa.concat_batches(held), length)

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """Text with what names a row: whether its id is null, the id, and a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.col("doc_id").isNull().cast("int").alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text).alias("h"), text.alias("text"),
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Byte ranges to remove (no_id, id, h, start, stop), which may overlap."""
    spark = docs.sparkSession
    rows = _rows(docs).drop("doc_id")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = Sizes.of(size)
    runs = rows.select("text").mapInArrow(_runs(sizes, length), "slice long, run binary")
    columns = ", ".join(f"{name} binary" for name in SETS)
    sets = runs.groupBy("slice").applyInPandas(_sets(sizes, hot), f"slice long, {columns}")
    bits = {name: bytearray(1 << ((sizes.hot if name == "hot" else sizes.repeated) - 3)) for name in SETS}
    for part in sets.toLocalIterator():
        for name, whole in bits.items():
            whole[part.slice * len(part[name]):(part.slice + 1) * len(part[name])] = part[name]
    shared = {name: spark.sparkContext.broadcast(bytes(whole)) for name, whole in bits.items()}
    found = rows.mapInArrow(_candidates(shared, sizes, length), ROWS)
    dealt = found.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_resolve(length), SPANS)


def _apply(length: int):
    """Adds the kept bytes and figures to rows with their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin, count in cuts(whole.column("text"), PIECE):
                batch = whole.slice(begin, count)
                data, bounds = text_bytes(batch.column("text"))
                starts, stops = (batch.column(name) for name in ("starts", "stops"))
                sizes = starts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                shift = np.repeat(bounds[:-1], sizes)
                start = starts.flatten().to_numpy(zero_copy_only=False) + shift
                stop = stops.flatten().to_numpy(zero_copy_only=False) + shift
                # A further row with the same id and text is a repeat as a whole.
                copy = batch.column("nth").to_numpy() > 1
                copy &= np.diff(bounds) >= length
                start = np.concatenate([start, bounds[:-1][copy]]).astype(np.int64)
                stop = np.concatenate([stop, bounds[1:][copy]]).astype(np.int64)
                change = np.bincount(start, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
                gone = np.cumsum(change[:len(data)]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                inner = bounds[:-1][bounds[:-1] < len(data)]
                edge[inner] = gone[inner]
                removed = np.concatenate([[0], np.cumsum(gone)])
                spans = np.concatenate([[0], np.cumsum(edge)])
                kept = data[~gone].tobytes()
                ends = (bounds - removed[bounds]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])),
                     pa.array(np.diff(spans[bounds])),
                     pa.array([kept[a:b] for a, b in zip(ends, ends[1:])], pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Per document its bytes, removed bytes and runs, and the bytes that stay (``kept``)."""
    name = ["no_id", "id", "h"]
    spans = stored(repeated_spans(docs, length, hot), "spans")
    lists = spans.groupBy(*name).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = _rows(docs).join(lists, name, "left")
    nth = F.row_number().over(Window.partitionBy(*name).orderBy(*name))
    rows = rows.select(
        "doc_id", "text", nth.alias("nth"), F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _apply(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )

