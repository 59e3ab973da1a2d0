"""Near-duplicate documents by Order MinHash, verified by banded alignment.

The k-mers of a text are its runs of ``K`` words, labelled with their occurrence number, so that
repeats count. Each sketch takes the ``ELL`` labelled k-mers that are smallest under its own hash
and keeps them in text order: two texts share it only if they share those k-mers in the same
order, which follows edit similarity rather than the mere overlap of sets. ``ROWS`` sketches form a
band; texts equal in a band are candidates. An edit changes at most ``K`` k-mers of either side, so
that long texts of similarity 0.8 share about 3/7 of all their k-mers or more wherever the edits lie,
and are candidates with probability of about 0.96 (0.85: 0.99) or more, if few words repeat. What no
band holds together is not compared: recall among long texts is high, not complete.

Texts of at most ``SHORT`` words have few k-mers, and are candidates by an exact rule among each
other: two texts within the threshold share so many words, repeats told apart, that one of the
``n - ceil(SIMILARITY * n) + 1`` rarest of each is common to both. Texts equal in such a word are
candidates, and no link between two of them is lost.

A candidate pair is a link if the edit similarity of the word sequences, 1 - distance / longer
length, is at least ``SIMILARITY``. The alignment runs diagonal by diagonal outwards from the main
one, with prefix hashes to jump over equal runs, and stops at the band the threshold allows; word
counts give a lower bound that settles most pairs of different texts without it. Classes are the
connected components of all links.

No bucket is expanded into all pairs. Texts of equal words are one node from the start. In each
bucket the first text is the representative. A text is first compared with one of its
representatives, then with another one and with the rest (``STAR_ROUNDS``), each time only where the links so far leave the
two in different components. Only texts still apart from their bucket's representative
are then compared with the others of the bucket that lie in other components, so a large group of copies costs few
comparisons per text, and no link between different components is lost within a bucket. Of those others, texts of
another length and texts with too many words that the other lacks are passed over in the join,
which takes the buckets in ``BUCKET_PARTS`` parts. The words of longer texts are not kept beside the sketches but
made again from the texts, for candidates only. What
is left grows with the square of the number of unlike texts that share a bucket, that is, the same
k-mers in the same order in every sketch of a band, or a rare word of short texts.

Defined cases: texts without words (also null) are one class if ``wordless`` is set and stay alone otherwise; every row is a
document, null and repeated ids too; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.bits import ONCE, bit_set, may_hold, rarity
from wardlake.llm.store import discard, stored
from wardlake.llm.text import give_back, mix, powers, slices, words

K = 2
ELL = 3
ROWS = 1
BANDS = 40
SHORT = 64  # words; shorter texts are also compared by the exact rule
RARITY_BITS = 20  # hash buckets counted for the rarity of words of short texts
SIMILARITY = 0.8
STAR_ROUNDS = (F.min, F.max, None)  # which representative a text is compared with; None: all that are left
SALTS = 16
LARGE = 1000  # members of a bucket that is dealt out by salts
BUCKET_PARTS = 4  # parts of the buckets in which texts are compared with many others
SLICE_BYTES = 1 << 20
_STEP = np.uint64(0xD1B54A32D192ED03)
_NONE = np.uint64(2**64 - 1)

SKETCHED = "rid long, doc_id long, key binary, n int, bands array<long>, tokens binary"
_SKETCHED_ARROW = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int32()),
    ("bands", pa.list_(pa.int64())), ("tokens", pa.binary()),
])


def _prefix(values: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of values: S[e] - S[b] * STEP ** (e - b) for b < e."""
    n = len(values)
    scaled = np.zeros(n + 1, np.uint64)
    inverse = powers(np.uint64(pow(int(_STEP), -1, 2**64)), n + 1)
    np.cumsum(values * inverse[1:], out=scaled[1:])
    return scaled * powers(_STEP, n + 1)


def kmers(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, k: int = K):
    """Hashes of all k-mers that lie within one text: text and place of each, and its hash."""
    n = np.maximum(ends - begins - k + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) + np.repeat(begins - (np.cumsum(n) - n), n)
    sums = _prefix(hashes)
    run = sums[place + k] - sums[place] * powers(_STEP, k + 1)[k]
    return text, place, mix(run)


def label_occurrences(text: np.ndarray, kmer: np.ndarray) -> np.ndarray:
    """Make equal k-mers of one text different by their occurrence number."""
    order = np.lexsort((kmer, text))
    same = np.zeros(len(order), bool)
    same[1:] = (text[order][1:] == text[order][:-1]) & (kmer[order][1:] == kmer[order][:-1])
    if not same.any():
        return kmer
    index = np.arange(len(order))
    number = index - np.maximum.accumulate(np.where(same, 0, index))
    labelled = kmer.copy()
    repeat = order[same]
    labelled[repeat] = mix(kmer[repeat] + number[same].astype(np.uint64) * _STEP)
    return labelled


def band_keys(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray,
              seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Texts with at least one k-mer, and for each its ``BANDS`` keys."""
    text, _, kmer = kmers(hashes, begins, ends)
    if not len(text):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.int64)
    labelled = label_occurrences(text, kmer)
    own = np.flatnonzero(np.diff(text, prepend=-1))
    sizes = np.diff(own, append=len(text))
    index = np.arange(len(text))
    keys = np.zeros((len(own), BANDS), np.uint64)
    for sketch in range(BANDS * ROWS):
        order = mix(labelled ^ mix(np.array([seed * 1000 + sketch + 1], np.uint64))[0])
        picks = []
        for _ in range(ELL):
            least = np.minimum.reduceat(order, own)
            # Labelled k-mers of one text differ, and so do their hashes: one place each.
            at = np.flatnonzero(order == np.repeat(least, sizes))
            if len(at) != len(own):  # texts with fewer than ELL k-mers have used all up
                at = at[np.diff(text[at], prepend=-1) != 0]
            picks.append(np.where(least == _NONE, 2**62, index[at]))
            order[at] = _NONE
        places = np.sort(np.stack(picks, axis=1), axis=1)
        value = np.zeros(len(own), np.uint64)
        for j in range(ELL):
            inside = places[:, j] < 2**62
            part = np.where(inside, kmer[np.minimum(places[:, j], len(kmer) - 1)], _NONE)
            value = mix(value * _STEP + part)
        band = sketch // ROWS
        keys[:, band] = mix(keys[:, band] * _STEP + value + np.uint64(band + 1))
    return text[own], keys.view(np.int64)


def _identities(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """128 bits for each text that tell its sequence of words."""
    low, high = _prefix(hashes), _prefix(mix(hashes ^ _STEP))
    run = powers(_STEP, int((ends - begins).max(initial=0)) + 1)[ends - begins]
    identity = np.stack([sums[ends] - sums[begins] * run for sums in (low, high)], axis=1).astype("<u8")
    return pa.array([row.tobytes() for row in identity], pa.binary())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of all texts; word hashes only of short ones, as these are all needed soon."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            found = words(part.column(2))
            ends = found.text_ends
            begins = np.concatenate([[0], ends[:-1]])
            texts, keys = band_keys(found.hashes, begins, ends)
            bands: list = [[]] * part.num_rows
            for text, row in zip(texts.tolist(), keys.tolist(), strict=True):
                bands[text] = row
            tokens = found.hashes.astype(np.uint32)
            short = [tokens[b:e].tobytes() if e - b <= SHORT else None for b, e in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                _identities(found.hashes, begins, ends),
                pa.array(ends - begins, pa.int32()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(short, pa.binary()),
            ], schema=_SKETCHED_ARROW)
    give_back()


def _token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of texts, under the texts' identities."""
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            found = words(part.column(0))
            ends = found.text_ends
            begins = np.concatenate([[0], ends[:-1]])
            tokens = found.hashes.astype(np.uint32)
            lists = [tokens[b:e].tobytes() for b, e in zip(begins, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [_identities(found.hashes, begins, ends), pa.array(lists, pa.binary())], names=["identity", "tokens"]
            )
    give_back()


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of each token list, made different by their occurrence number."""
    for batch in batches:
        lists = [np.frombuffer(t.as_buffer(), np.uint32) for t in batch.column(2)]
        text = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        labelled = label_occurrences(text, mix(np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.uint64)))
        ends = np.cumsum([0, *map(len, lists)])
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(labelled.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["key", "n", "words"])


_VOCABULARY = "key long, n int, label long, buckets array<long>, words array<int>"


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the distinct words of each token list (the last column) in its place."""
    for batch in batches:
        *others, lists = batch.columns
        words = [np.unique(np.frombuffer(t.as_buffer(), np.int32)) for t in lists]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array(words, pa.list_(pa.int32()))], names=["key", "n", "label", "buckets", "words"]
        )


def _short_keys(nodes: DataFrame, tokens: DataFrame, similarity: float) -> DataFrame:
    """Buckets (``key``, ``n``, ``bucket``) of which two short texts that are alike share one."""
    short = nodes.where(F.col("n").between(1, SHORT)).select(F.col("node").alias("key"), "n")
    some = short.join(tokens, "key").select("key", "n", "tokens")
    words = stored(some.mapInArrow(_labelled_words, "key long, n int, words array<long>"), "short-words")
    # Rarity is the count of a word's hash bucket: an order like any other, the result is the same.
    levels = rarity(words.select(F.explode("words").alias("hash")), RARITY_BITS)
    place = lambda word: F.pmod(word, F.lit(1 << RARITY_BITS)).cast("int")
    code = lambda word: F.struct(F.get("_levels", place(word)).alias("level"), word.alias("word"))
    prefix = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    rarest = F.slice(F.sort_array(F.transform("words", code)), F.lit(1), prefix)
    entries = words.withColumn("_levels", levels).select("key", "n", F.explode(rarest).alias("entry"))
    # A word that is alone in its bucket is in no other text.
    entries = entries.where(F.col("entry.level") > ONCE)
    return entries.select("key", "n", F.xxhash64(F.lit(-1), "entry.word").alias("bucket"))


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: words that one side has and the other lacks."""
    values, side = np.unique(np.concatenate([a, b]), return_inverse=True)
    more = np.bincount(side[:len(a)], minlength=len(values)) - np.bincount(
        side[len(a):], minlength=len(values)
    )
    return int(max(more[more > 0].sum(), -more[more < 0].sum()))


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two word sequences if it is at most ``most``.

    For each distance, the furthest place reached on every diagonal of the band is kept, and runs
    of equal words are jumped over by comparing hashes of runs (doubling, then halving steps).
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    sums_a, sums_b = _prefix(mix(a.astype(np.uint64) + _STEP)), _prefix(mix(b.astype(np.uint64) + _STEP))
    power = powers(_STEP, max(n, m) + 2)

    def slide(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from a[x] and b[y] on are equal."""
        room = np.minimum(n - x, m - y)
        done = np.zeros(len(x), np.int64)
        step = 1 << max(0, int(room.max(initial=0)).bit_length())
        while step:
            more = done + step
            able = np.flatnonzero(more <= room)
            if len(able):
                i, j, size = x[able], y[able], more[able]
                equal = (sums_a[i + size] - sums_a[i] * power[size]) == (
                    sums_b[j + size] - sums_b[j] * power[size]
                )
                done[able[equal]] = size[equal]
            step >>= 1
        return done

    goal = m - n  # diagonal y - x of the far corner
    low, far = 0, np.array([int(slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0])])
    for distance in range(most + 1):
        if distance:
            # One more edit: from the diagonals beside (one word more in a or b) or the same one.
            reach = np.full(len(far) + 4, -1, np.int64)
            reach[2:-2] = far
            down, same, right = reach[2:], reach[1:-1], reach[:-2]
            far = np.maximum(np.maximum(down + 1, same + 1), right)
            far[(down < 0) & (same < 0) & (right < 0)] = -1
            low -= 1
            diagonal = low + np.arange(len(far))
            far = np.minimum(far, np.minimum(n, m - diagonal))
            keep = (np.abs(diagonal - goal) <= most - distance) & (far >= 0) & (far + diagonal >= 0)
            if not keep.any():
                return None
            inside = np.flatnonzero(keep)
            first, last = inside[0], inside[-1] + 1
            low, far, keep = low + first, far[first:last], keep[first:last]
            diagonal = diagonal[first:last]
            at = np.flatnonzero(keep)
            far[~keep] = -1
            far[at] += slide(far[at], far[at] + diagonal[at])
        place = goal - low
        if 0 <= place < len(far) and far[place] >= n:
            return distance
    return None


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column(2), batch.column(3), strict=True):
                a = np.frombuffer(left.as_buffer(), np.uint32)
                b = np.frombuffer(right.as_buffer(), np.uint32)
                most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
                linked.append(
                    abs(len(a) - len(b)) <= most
                    and least_distance(a, b) <= most
                    and edit_distance(a, b, most) is not None
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(linked, pa.bool_())],
                names=["a", "b", "linked"],
            )
        give_back()

    return verify


def verified(pairs: DataFrame, tokens: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Which of the pairs (``a``, ``b``) are links; ``tokens`` has one row per key."""
    left = tokens.select(F.col("key").alias("a"), F.col("tokens").alias("tokens_a"))
    right = tokens.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    # Alignments differ much in cost: deal the pairs out evenly.
    dealt = both.select("a", "b", "tokens_a", "tokens_b").repartition(F.xxhash64("a", "b"))
    return dealt.mapInArrow(_verify(similarity), "a long, b long, linked boolean")


def components(links: DataFrame) -> DataFrame:
    """Connected components: ``key`` and the smallest key of its component, ``label``.

    Every key takes the smallest label around it, then the label of its label, until nothing
    changes. All steps are joins and partial minima; each round is written to the shared folder.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("x").alias("key")).agg(F.least("key", F.min("y")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("key").alias("y"), "label"), "y").groupBy(
            F.col("x").alias("key")
        ).agg(F.min("label").alias("near"))
        nearer = labels.join(around, "key").select("key", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("key").alias("next"), F.col("label").alias("jump"))
        after = stored(
            nearer.join(jump, "next").select(
                "key", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("moved")
            ),
            "labels",
        )
        discard(labels)
        labels = after.select("key", "label")
        if after.where("moved").isEmpty():
            discard(both)
            return labels


def _links(
    nodes: DataFrame, short_tokens: DataFrame, tokens_of: Callable[[DataFrame], DataFrame], similarity: float
) -> DataFrame:
    """Verified links between nodes (``node``, ``n``, ``bands``).

    ``short_tokens`` has the words of short texts by ``key``; ``tokens_of`` makes those of the wanted keys.
    """
    banded = nodes.select(F.col("node").alias("key"), "n", F.posexplode("bands").alias("band", "value"))
    banded = banded.select("key", "n", F.xxhash64("band", "value").alias("bucket"))
    short = stored(_short_keys(nodes, short_tokens, similarity), "short-keys")
    banded = banded.unionByName(short)

    def beside(members: DataFrame) -> DataFrame:
        """Members with the first one of their bucket; buckets of one member give no candidates.

        Large buckets are dealt out by salts. Which ones are large is told by a bit set, so that both
        sides agree, and small buckets are not repeated for every salt.
        """
        reps = members.groupBy("bucket").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
        reps = stored(reps.where("size > 1"), "representatives")
        large = bit_set(reps.where(F.col("size") > LARGE).select(F.col("bucket").alias("hash")))
        dealt = may_hold(large, F.col("bucket"))
        salts = F.when(dealt, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        salt = F.when(dealt, F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(0)
        reps = reps.select("bucket", "rep", F.explode(salts).alias("salt"))
        return members.withColumn("salt", salt).join(reps, ["bucket", "salt"]).drop("salt")

    # Texts of a bucket whose lengths differ too much are parted: each is in two length classes, and
    # two texts that may be similar share one of them.
    # Buckets of one member go before anything is written.
    shared = beside(banded).select("key", "n", "bucket")
    lowest = F.floor(F.log(F.greatest("n", F.lit(1))) / (log(1 / similarity) + 1e-6))
    length = F.explode(F.array(lowest, lowest + 1))
    shared = shared.withColumn("length", length)
    shared = stored(shared.select("key", "n", F.xxhash64("bucket", "length").alias("bucket")), "classes")
    discard(short)
    live = stored(beside(shared), "beside")
    tokens = stored(tokens_of(live.select("key").distinct()), "tokens")
    stars = stored(live.where("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    links = labels = None

    def parted(rows: DataFrame, one: str, other: str) -> DataFrame:
        """Rows whose two texts are not in one component yet."""
        if labels is None:
            return rows
        for name in (one, other):
            known = labels.select(F.col("key").alias(name), F.col("label").alias(f"{name}_label"))
            rows = rows.join(known, name, "left").withColumn(f"{name}_label", F.coalesce(f"{name}_label", name))
        return rows.where(F.col(f"{one}_label") != F.col(f"{other}_label")).drop(f"{one}_label", f"{other}_label")

    for choose in STAR_ROUNDS:
        # First one representative a text; what its component settles need not be compared.
        pairs = parted(stars, "a", "b")
        if choose:
            pairs = pairs.groupBy("a").agg(choose("b").alias("b"))
        found = stored(verified(pairs, tokens, similarity).where("linked").select("a", "b"), "star-links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
    aparts = stored(parted(live.where("key <> rep"), "key", "rep").drop("rep"), "apart")
    discard(live, stars)
    if aparts.isEmpty():
        return links
    label = F.coalesce("label", "key")
    # Texts apart from the first one, against the rest of the bucket in other components. Each text has one
    # row with its buckets of that kind (at most two for each sketch or rare word) and its words.
    mixed = bit_set(aparts.select(F.col("bucket").alias("hash")))
    buckets = shared.groupBy("key", "n").agg(F.collect_set("bucket").alias("buckets"))
    kept = F.filter("buckets", lambda bucket: may_hold(F.col("_mixed"), bucket))
    buckets = buckets.withColumn("_mixed", mixed).select("key", "n", kept.alias("buckets"))
    buckets = buckets.where(F.size("buckets") > 0).join(labels, "key", "left")
    some = buckets.join(tokens, "key").select("key", "n", label.alias("label"), "buckets", "tokens")
    texts = stored(some.mapInArrow(_vocabulary, _VOCABULARY), "words")

    def side(members: DataFrame, name: str) -> DataFrame:
        return members.select("bucket", *(
            F.col(column).alias(f"{name}_{column}" if column != "key" else name)
            for column in ("key", "n", "label", "words", "buckets")
        ))

    def in_part(part: int) -> Callable[[Column], Column]:
        return lambda bucket: F.pmod(bucket, F.lit(BUCKET_PARTS)) == part

    # Each distinct word that the other text lacks is an edit, whatever else differs.
    most = (1 - similarity) * F.greatest("a_n", "b_n") + 1e-9
    close = F.abs(F.col("a_n") - F.col("b_n")) <= most
    # A pair that shares several buckets is looked at in the first of them only.
    close = close & (F.array_min(F.array_intersect("a_buckets", "b_buckets")) == F.col("l.bucket"))
    for one, other in (("a_words", "b_words"), ("b_words", "a_words")):
        close = close & (F.size(F.array_except(one, other)) <= most)
    # The buckets are taken in parts, one after the other, so that the wide rows of one part only are on disk.
    rest = None
    for part in range(BUCKET_PARTS):
        left = side(aparts.where(in_part(part)(F.col("bucket"))).select("key", "bucket").join(texts, "key"), "a")
        right = texts.withColumn("bucket", F.explode(F.filter("buckets", in_part(part))))
        pairs = left.alias("l").join(
            side(right, "b").alias("r"),
            (F.col("l.bucket") == F.col("r.bucket")) & (F.col("a_label") != F.col("b_label")) & close,
        )
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        rest = pairs if rest is None else rest.unionByName(pairs)
    found = stored(verified(rest.distinct(), tokens, similarity).where("linked").select("a", "b"), "more-links")
    discard(shared, aparts, texts, tokens, rest)
    return links.unionByName(found)


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, wordless: bool = False
) -> DataFrame:
    """Per row: ``class_id`` (smallest id of its class), ``class_size`` in rows, and ``kept``.

    Of each class the row with the smallest id stays; of rows with that same id, the first.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "rid", F.monotonically_increasing_id()
    )
    return _classified(chosen, similarity, wordless)


def _classified(
    chosen: DataFrame, similarity: float = SIMILARITY, wordless: bool = False
) -> DataFrame:
    """Classes of rows with ``rid``, ``doc_id`` and ``text``."""
    sketched = chosen.select("rid", "doc_id", "text").mapInArrow(_sketch, SKETCHED)
    sketches = stored(sketched, "sketches")
    # One node per distinct word sequence; copies are reduced before the shuffle.
    copies = stored(sketches.groupBy("key").agg(F.min("rid").alias("node")), "nodes")
    firsts = copies.select(F.col("node").alias("rid"))
    nodes = sketches.select("rid", "n", "bands").where("n > 0").join(firsts, "rid", "left_semi")
    short_tokens = sketches.where(F.col("n").between(1, SHORT)).select(F.col("rid").alias("key"), "tokens")

    def tokens_of(keys: DataFrame) -> DataFrame:
        """Words of the nodes (``key``), made again from the texts: few are needed, and all are as large as the texts."""
        named = copies.join(keys.withColumnRenamed("key", "node"), "node", "left_semi")
        named = stored(named.select(F.col("key").alias("identity"), F.col("node").alias("key")), "named")
        some = may_hold(bit_set(named.select(F.xxhash64("identity").alias("hash"))), F.xxhash64("identity"))
        lists = chosen.select("text").mapInArrow(_token_lists, "identity binary, tokens binary").where(some)
        return lists.join(named, "identity").select("key", "tokens").dropDuplicates(["key"])

    links = _links(nodes.withColumnRenamed("rid", "node"), short_tokens, tokens_of, similarity)
    labels = components(links).select(F.col("key").alias("node"), "label")

    placed = copies.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("label"))
    rows = sketches.select("rid", "doc_id", "key", "n").join(placed, "key")
    if not wordless:
        rows = rows.withColumn("label", F.when(F.col("n") == 0, F.col("rid")).otherwise(F.col("label")))
    rows = stored(rows.select("rid", "doc_id", "n", "label"), "placed")
    discard(sketches, copies)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    classes = rows.groupBy("label").agg(first.alias("first"), F.count("*").alias("class_size"))
    classes = classes.select("label", "first.doc_id", F.col("first.rid").alias("first_rid"), "class_size")
    classes = classes.withColumnRenamed("doc_id", "class_id")
    return rows.join(classes, "label").select(
        "doc_id", "class_id", "class_size", (F.col("rid") == F.col("first_rid")).alias("kept"),
        F.col("n").cast("long").alias("n_words"), "rid",
    )


def without_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with all columns of ``docs``."""
    whole = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))
    whole = stored(whole, "numbered")
    texts = whole.select("rid", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text"))
    kept = _classified(texts, similarity).where("kept").select("rid")
    return whole.join(kept, "rid", "left_semi").select("row.*")
