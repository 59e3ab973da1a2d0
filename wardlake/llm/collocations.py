"""Phrase collocations, counted in HAT-tries.

Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces into words
at spaces and tabs. Per language the score of a phrase of 2 to 5 words is
``floor(1000 * a * n / (l * r))`` for the cut that makes it lowest: ``a``, ``l`` and ``r`` count the
phrase and its two parts, ``n`` all words.

*Counting.* A task counts phrases in one ``HatTrie`` per language: a trie over the digits of word
ids (64-bit hashes), few levels deep, whose leaves are hash tables. A table that grows beyond
``BURST`` entries bursts into a node with a table per digit. When the tries of a task fill their
memory, the largest subtrees are spilled whole, as sorted runs cut at prefixes of the trie's path.
The runs of a prefix meet in one task, which merges them and drops phrases below the threshold.
The path takes digits of the first and the second word in turn, so the phrases of one very common
first word are spread over many prefixes, and a phrase costs one entry per task, however often it occurs.

Three passes: words, then pairs of words that are frequent, then phrases of 3 to 5 words whose pairs are
all frequent. A phrase cannot be more frequent than the words and pairs in it, so nothing is lost. What
is frequent is handed to the tasks as a bit set by hash, of at most 16 MiB; with more keys than
it can tell apart more phrases are counted, and the result is the same.

*Scoring* joins phrases with their parts, salted, in exact decimal arithmetic. A phrase is dropped if
a candidate that is longer and holds it is as frequent. Such a candidate has one word more or holds one
with one word more that is as frequent, so only those are looked at.

Defined cases: a null text counts as empty, a null language as ``und``; ties go by score, ``a`` and then
the UTF-8 bytes of the phrase, so the order is total; repeated rows count as often as they occur; extra columns are ignored; an
empty table gives no rows. A long text is counted in parts cut between pieces; one piece is
always handled whole. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.bits import holds
from wardlake.llm.store import stored
from wardlake.llm.text import (
    _BASE, _BASE_INVERSE, _BYTE_VALUES, _LOWER, cuts, mix, powers, text_bytes,
)

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a phrase
TOP = 2000  # phrases reported per language
COVERED = 100  # percent of a phrase's occurrences that lie in a longer one, from which it is dropped
NO_LANG = "und"

DIGIT = 6  # bits of a trie level
LEVELS = 8
BURST = 1 << 15
TRIE_BYTES = 96 << 20  # held by all tries of a task
PIECE = 1 << 20
SLICE_WORDS = 1 << 17  # words of the corpus per prefix partition
MOST_BITS = 27
SALTS = 8

_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
_IN_WORD = ~_BREAKS
_IN_WORD[list(b" \t")] = False
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Hash container: phrases (rows of word ids) with their counts, by open addressing."""

    def __init__(self, width: int, named: bool, room: int = 64) -> None:
        self.grams = np.zeros((room, width), np.uint64)
        self.counts = np.zeros(room, np.int64)
        self.names = np.empty(room, object) if named else None
        self.size = 0

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        at = np.flatnonzero(self.counts)
        return self.grams[at], self.counts[at], None if self.names is None else self.names[at]

    def add(self, grams: np.ndarray, counts: np.ndarray, names: np.ndarray | None) -> None:
        """Count distinct phrases."""
        room = len(self.counts)
        if 2 * (self.size + len(counts)) > room:
            while 2 * (self.size + len(counts)) > room:
                room *= 2
            old = self.entries()
            self.__init__(grams.shape[1], self.names is not None, 2 * room)
            self.add(*old)
        mask = len(self.counts) - 1
        hashed = np.zeros(len(grams), np.uint64)
        for column in grams.T:
            hashed = mix(hashed * _FACTOR + column)
        slot = (hashed & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(grams))
        owner = np.empty(mask + 1, np.int64)
        while len(left):
            here = slot[left]
            free = self.counts[here] == 0
            # Of several that want a free slot one gets it.
            owner[here[free]] = left[free]
            won = np.zeros(len(left), bool)
            won[free] = owner[here[free]] == left[free]
            mine, place = left[won], here[won]
            self.grams[place], self.counts[place] = grams[mine], counts[mine]
            if names is not None:
                self.names[place] = names[mine]
            self.size += len(mine)
            same = ~free
            same[same] = (self.grams[here[same]] == grams[left[same]]).all(axis=1)
            self.counts[here[same]] += counts[left[same]]
            left = left[~won & ~same]
            slot[left] = (slot[left] + 1) & mask


class HatTrie:
    """Counts of phrases of one length: trie nodes by digits of word ids, tables at the leaves."""

    def __init__(self, width: int, named: bool = False) -> None:
        self.width, self.named = width, named
        self.root: list = [None] * (1 << DIGIT)
        self.sizes = np.zeros(1 << DIGIT, np.int64)

    def digit(self, grams: np.ndarray, level: int) -> np.ndarray:
        """Digits come from the first two words in turn, highest bits first."""
        first = min(self.width, 2)
        shift = np.uint64(64 - DIGIT * (level // first + 1))
        return ((grams[:, level % first] >> shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)

    def prefix(self, grams: np.ndarray, bits: int) -> np.ndarray:
        """The first ``bits`` bits of the path: the partition of a phrase."""
        path = np.zeros(len(grams), np.int64)
        levels = -(-bits // DIGIT)
        for level in range(levels):
            path = (path << DIGIT) | self.digit(grams, level)
        return path >> (levels * DIGIT - bits)

    def add(self, grams: np.ndarray, counts: np.ndarray, names: np.ndarray | None = None) -> None:
        self._add(self.root, 0, grams, counts, names, True)

    def _add(self, node: list, level: int, grams, counts, names, top: bool = False) -> None:
        digits = self.digit(grams, level)
        order = np.argsort(digits, kind="stable")
        edges = np.flatnonzero(np.diff(digits[order])) + 1
        for part in np.split(order, edges) if len(order) else ():
            at = int(digits[part[0]])
            child, own = node[at], None if names is None else names[part]
            if isinstance(child, list):
                self._add(child, level + 1, grams[part], counts[part], own)
            else:
                if child is None:
                    child = node[at] = Table(self.width, self.named)
                child.add(grams[part], counts[part], own)
                if child.size > BURST and level + 1 < LEVELS:
                    node[at] = [None] * (1 << DIGIT)
                    self._add(node[at], level + 1, *child.entries())
            if top:
                self.sizes[at] = self._size(node[at])

    def _size(self, node) -> int:
        if isinstance(node, list):
            return sum(self._size(child) for child in node if child is not None)
        return node.size

    def __len__(self) -> int:
        return int(self.sizes.sum())

    def _tables(self, node) -> Iterator[Table]:
        for child in node if isinstance(node, list) else [node]:
            if isinstance(child, list):
                yield from self._tables(child)
            elif child is not None:
                yield child

    def spill(self, keep: int, bits: int) -> Iterator[tuple[int, bytes]]:
        """Take out the largest subtrees until ``keep`` entries are left: sorted runs by prefix."""
        for at in np.argsort(-self.sizes, kind="stable").tolist():
            if len(self) <= keep or not self.sizes[at]:
                return
            parts = [table.entries() for table in self._tables(self.root[at])]
            self.root[at], self.sizes[at] = None, 0
            grams, counts = (np.concatenate([part[side] for part in parts]) for side in (0, 1))
            names = np.concatenate([part[2] for part in parts]) if self.named else None
            prefix = self.prefix(grams, bits)
            order = np.lexsort((*reversed(grams.T), prefix))
            edges = np.flatnonzero(np.diff(prefix[order])) + 1
            for part in np.split(order, edges):
                yield int(prefix[part[0]]), pack(grams[part], counts[part], None if names is None else names[part])


def pack(grams: np.ndarray, counts: np.ndarray, names: np.ndarray | None) -> bytes:
    """A run: byte planes of the ids and the counts, then the names with their sizes."""
    parts = [np.array(grams.shape, "<i4")]
    for column in [*grams.T, counts.astype(np.uint64)]:
        planes = np.ascontiguousarray(column).astype("<u8").view(np.uint8).reshape(-1, 8).T
        parts.append(np.ascontiguousarray(planes))
    if names is not None:
        parts += [np.array([len(name) for name in names], "<i4"), b"".join(names)]
    return b"".join(part if isinstance(part, bytes) else part.tobytes() for part in parts)


def unpack(raw: bytes, named: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    n, width = np.frombuffer(raw, "<i4", 2).tolist()
    planes = np.frombuffer(raw, np.uint8, 8 * n * (width + 1), 8).reshape(width + 1, 8, n)
    columns = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u8").reshape(width + 1, n)
    names = None
    if named:
        at = 8 + 8 * n * (width + 1)
        ends = np.cumsum(np.frombuffer(raw, "<i4", n, at)).tolist()
        data = raw[at + 4 * n:]
        names = np.empty(n, object)
        names[:] = [data[a:b] for a, b in zip([0, *ends], ends)]
    return columns[:-1].T.astype(np.uint64), columns[-1].astype(np.int64), names


def merged(runs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """One run from several sorted ones."""
    grams, counts = (np.concatenate([run[side] for run in runs]) for side in (0, 1))
    order = np.lexsort(tuple(reversed(grams.T)))
    grams, counts = grams[order], counts[order]
    new = np.ones(len(order), bool)
    new[1:] = (grams[1:] != grams[:-1]).any(axis=1)
    begins = np.flatnonzero(new)
    names = None if runs[0][2] is None else np.concatenate([run[2] for run in runs])[order][begins]
    return grams[begins], np.add.reduceat(counts, begins) if len(begins) else counts, names


# A batch of words: raw bytes, starts, ends, ids, and numbers that change from piece to piece.
Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _parts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long single text in parts cut before a break; others as they are."""
    if len(bounds) > 2 or len(data) <= 2 * PIECE:
        yield data, bounds
        return
    begin = 0
    while begin < len(data):
        end = min(len(data), begin + PIECE)
        while end < len(data):
            step = data[end:end + PIECE]
            breaks = np.flatnonzero(_BREAKS[step])
            if len(breaks):
                end += int(breaks[0])
                break
            end += len(step)
        yield data[begin:end], np.array([0, end - begin])
        begin = end


def _words(data: np.ndarray, bounds: np.ndarray, seed: np.uint64) -> Words:
    inside = _IN_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[bounds] = True
    starts = np.flatnonzero(inside & edge[:-1])
    ends = np.flatnonzero(inside & edge[1:]) + 1
    lower = _LOWER[data]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[lower] * powers(_BASE, len(data)), out=sums[1:])
    ids = mix(((sums[ends] - sums[starts]) * powers(_BASE_INVERSE, len(data))[starts]) ^ seed)
    piece = np.cumsum(_BREAKS[data])[starts] + np.searchsorted(bounds, starts, "right")
    return lower, starts, ends, ids, piece


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words]]:
    """Words of each language, in parts of about ``PIECE`` bytes of text."""
    for whole in batches:
        langs = whole.column("lang")
        for lang in pc.unique(langs).to_pylist():
            texts = whole.column("text").filter(pc.equal(langs, lang))
            raw = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
            seed = mix(np.array([(raw * powers(_BASE, max(1, len(raw)))[:len(raw)]).sum() + np.uint64(len(raw))]))[0]
            for begin, count in cuts(texts, PIECE):
                for data, bounds in _parts(*text_bytes(texts.slice(begin, count))):
                    if len(data):
                        yield lang, _words(data, bounds, seed)


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense codes, and per code its number and first place."""
    dense, values = pd.factorize(codes)
    first = np.empty(len(values), np.int64)
    first[dense[::-1]] = np.arange(len(dense))[::-1]
    return dense.astype(np.uint64), np.bincount(dense, minlength=len(values)), first


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _FACTOR + second)


def _single(words: Words):
    lower, starts, ends, ids, _ = words
    _, counts, first = _distinct(ids)
    raw = lower.tobytes()
    names = np.empty(len(first), object)
    names[:] = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    yield 1, ids[first][:, None], counts, names


def _pairs(frequent, bits: int):
    def find(words: Words):
        ids, piece = words[3:]
        fine = holds(frequent, bits, ids)
        at = np.flatnonzero(fine[:-1] & fine[1:] & (piece[:-1] == piece[1:]))
        codes = pd.factorize(ids)[0].astype(np.uint64)
        _, counts, first = _distinct((codes[at] << np.uint64(32)) | codes[at + 1])
        first = at[first]
        yield 2, np.stack([ids[first], ids[first + 1]], axis=1), counts, None

    return find


def _longer(frequent, bits: int, longest: int):
    def find(words: Words):
        ids, piece = words[3:]
        fine = piece[:-1] == piece[1:]
        fine[fine] = holds(frequent, bits, pair_key(ids[:-1][fine], ids[1:][fine]))
        codes = pd.factorize(ids)[0].astype(np.uint64)
        # Codes of the phrases one word shorter, by the place of their first word.
        chain, alive = codes, np.flatnonzero(fine)
        for width in range(2, longest + 1):
            if not len(alive):
                return
            dense, counts, first = _distinct((chain[alive] << np.uint64(32)) | codes[alive + width - 1])
            if width > 2:
                first = alive[first]
                yield width, np.stack([ids[first + step] for step in range(width)], axis=1), counts, None
            chain = np.zeros(len(ids), np.uint64)
            chain[alive] = dense
            alive = alive[alive + width < len(ids)]
            alive = alive[fine[alive + width - 1]]

    return find


def _count(find: Callable, bits: int):
    """Runs (lang, slice, run) of what ``find`` yields, counted in tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[tuple[str, int], HatTrie] = {}

        def spilled(keep: float) -> Iterator[pa.RecordBatch]:
            for (lang, width), trie in tries.items():
                rows = list(trie.spill(int(keep * len(trie)), bits))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(rows), pa.string()), pa.array([width] * len(rows), pa.int32()),
                     pa.array([row[0] for row in rows], pa.int64()), pa.array([row[1] for row in rows], pa.binary())],
                    ["lang", "width", "slice", "run"],
                )

        for lang, words in _by_lang(batches):
            for width, grams, counts, names in find(words):
                if (lang, width) not in tries:
                    tries[lang, width] = HatTrie(width, names is not None)
                tries[lang, width].add(grams, counts, names)
            held = sum(len(trie) * (100 if trie.named else 24 * (trie.width + 1)) for trie in tries.values())
            if held > TRIE_BYTES:
                yield from spilled(0.5)
        yield from spilled(0)

    return run


_COUNTS = "lang string, width int, ids array<bigint>, name string, f long"


def _merge(least: int, named: bool):
    """Frequent phrases of the prefix partitions, whose runs arrive one partition after the other."""

    def one(lang: str, width: int, runs: list[bytes]) -> pa.RecordBatch:
        grams, counts, names = merged([unpack(raw, named) for raw in runs])
        keep = counts >= least
        ids = [row.tolist() for row in grams[keep].view(np.int64)]
        texts = [name.decode("utf-8", "replace") for name in names[keep]] if named else [None] * len(ids)
        f = counts[keep].tolist()
        if named:  # all words of the partition, rare ones too
            ids, texts, f = [*ids, None], [*texts, None], [*f, int(counts.sum())]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(f), pa.string()), pa.array([width] * len(f), pa.int32()),
             pa.array(ids, pa.list_(pa.int64())), pa.array(texts, pa.string()), pa.array(f, pa.int64())],
            ["lang", "width", "ids", "name", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            keys = zip(*(batch.column(name).to_pylist() for name in ("lang", "width", "slice")))
            for key, raw in zip(keys, batch.column("run")):
                if key != at and held:
                    yield one(at[0], at[1], held)
                    held = []
                at = key
                held.append(raw.as_py())
        if held:
            yield one(at[0], at[1], held)

    return run


def _frequent(rows: DataFrame, find: Callable, bits: int, least: int, named: bool) -> DataFrame:
    runs = rows.mapInArrow(_count(find, bits), "lang string, width int, slice long, run binary")
    key = ["lang", "width", "slice"]
    dealt = runs.repartition(*key).sortWithinPartitions(*key)
    return stored(dealt.mapInArrow(_merge(least, named), _COUNTS), "phrases")


def _bit_set(keys: DataFrame, number: int):
    """Bit set of the keys (column ``key``) in their highest bits, as a broadcast, and its size."""
    bits = min(MOST_BITS, max(16, (16 * number).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = keys.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("value"))
    filled = np.zeros(1 << (bits - 6), "<i8")
    table = words.toArrow()
    filled[table["word"].to_numpy()] = table["value"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(filled.tobytes()), bits


def _held(make: Callable, shared, *rest):
    """``make`` over the bit set's bytes, read in the task."""
    built = []

    def find(words: Words):
        if not built:
            built.append(make(np.frombuffer(shared.value, np.uint8), *rest))
        return built[0](words)

    return find


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Words and phrases with at least ``least`` occurrences (lang, ids, name of a word, f), and words per language."""
    rows = docs.select(
        F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = _frequent(rows, _single, 10, least, True)
    totals = words.where("ids IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    totals = stored(totals, "totals")
    words = words.where("ids IS NOT NULL")
    everything = totals.agg(F.sum("n")).first()[0] or 0
    bits = min(4 * DIGIT, max(4, (everything // SLICE_WORDS).bit_length()))
    shared, size = _bit_set(words.select(F.col("ids")[0].alias("key")), words.count())
    pairs = _frequent(rows, _held(_pairs, shared, size), bits, least, False)
    if longest == 2:
        return words.unionByName(pairs), totals
    shared, size = _bit_set(_pair_keys(pairs), pairs.count())
    longer = _frequent(rows, _held(_longer, shared, size, longest), bits, least, False)
    return words.unionByName(pairs).unionByName(longer), totals


def _pair_keys(pairs: DataFrame) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids").flatten().to_numpy().view(np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(ids[:, 0], ids[:, 1]).view(np.int64))], ["key"])

    return pairs.select("ids").mapInArrow(keys, "key long")


def _salted(rows: DataFrame, on: str, by: Column, table: DataFrame) -> DataFrame:
    """Join with ``table`` on a column that a few values may dominate."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(
        table.withColumn("salt", salts), [on, "salt"]
    ).drop("salt")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, covered: int = COVERED
) -> DataFrame:
    """The ``top`` phrases of each language (all for ``None``) with their counts and scores."""
    counts, totals = phrase_counts(docs, least, longest)
    size = F.size("ids")
    grams = counts.where(size > 1).select("lang", "ids", F.col("f").alias("a"))

    # The most frequent candidate with one word more around each phrase.
    around = grams.where(size > 2).select(
        F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids"), "a"
    )
    around = around.groupBy("ids").agg(F.max("a").alias("longer"))
    kept = grams.join(around, "ids", "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a"))
    ).drop("longer")

    known = counts.select("ids", "f")
    cut = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
        F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"),
    )
    by = F.col("ids")
    cut = _salted(cut, "left", by, known.withColumnsRenamed({"ids": "left", "f": "l"})).drop("left")
    cut = _salted(cut, "right", by, known.withColumnsRenamed({"ids": "right", "f": "r"})).drop("right")
    exact = {name: F.col(name).cast("decimal(18,0)") for name in "alrn"}
    over = F.lit(1000).cast("decimal(4,0)") * (exact["a"] * exact["n"])
    cut = cut.join(totals, "lang").withColumn("over", over).withColumn("under", exact["l"] * exact["r"])
    best = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r", "n")).alias("cut")
    scored = cut.groupBy("lang", "ids", "a").agg(best).select("lang", "ids", "a", "cut.*")
    if top is not None:
        scored = _first(scored, top, F.rank(), "ids", F.desc("score"), F.desc("a"))

    names = counts.where(size == 1).select(F.col("ids")[0].alias("id"), "name")
    spelled = scored.select("*", F.posexplode("ids").alias("at", "id"))
    spelled = _salted(spelled, "id", by, names)
    spelled = spelled.groupBy("lang", "ids", "a", "l", "r", "n", "score").agg(
        F.array_sort(F.collect_list(F.struct("at", "name"))).alias("words")
    )
    phrases = spelled.withColumn("phrase", F.array_join("words.name", " "))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if top is not None:
        phrases = _first(phrases, top, F.row_number(), "phrase", *order)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return phrases.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _first(rows: DataFrame, top: int, rank: Column, by: str, *order: Column) -> DataFrame:
    """Rows of rank ``top`` or better per language: first among 64 parts of each, then overall."""
    part = F.pmod(F.xxhash64(by), F.lit(64))
    for window in (Window.partitionBy("lang", "part"), Window.partitionBy("lang")):
        rows = rows.withColumn("part", part).withColumn("place", rank.over(window.orderBy(*order)))
        rows = rows.where(F.col("place") <= top).drop("part", "place")
    return rows
