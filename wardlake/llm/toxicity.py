"""Toxicity by compression distance.

Separate zstandard dictionaries are trained, one on ordinary text and others on the toxic passages of toxic
texts: a strict choice of passages and a wide one. Windows of 2 and of 8 words, each half a window apart, are
compressed with the ordinary dictionary alone and together with a toxic one; the bytes that the toxic one
saves are the window's margin. Short windows tell words well, long ones phrases. It tells toxic words and also
toxic phrases of ordinary words: the ordinary dictionary knows each word of a phrase, the toxic one the
whole phrase, which costs one match instead of several.

Toxic passages are found by contrast, as the two classes share most of their text: byte runs of the
lengths ``RUNS`` that more toxic texts hold than the ordinary texts that hold them explain (a binomial tail
below ``CHANCES``, one for each choice). Short runs find words and
parts of words, long ones phrases. Of runs that overlap, those count that are at least half as frequent
as the others. A passage is a stretch of such runs, also over a few bytes between them if it comes
again. Rare runs count as soon as they are unlikely to be chance.

The dictionaries overfit the texts they are trained on, so the margins that calibrate the thresholds come
from ``PARTS`` dictionaries, each trained without the texts that it is applied to. Per text the
windows are counted whose margin reaches rising thresholds; a logistic regression on these
counts, on the same training rows, sets the thresholds' worth and gives a score from 0 to 1. It
sees nothing but the margins and the number of windows.

Training takes a bounded sample in one task: ``TRAIN_ROWS`` labelled rows of at most
``TRAIN_BYTES`` bytes each, by hash of their id. Scoring covers every whole text. A window that
shares no run of ``SHARED`` bytes with a toxic dictionary has next to nothing to be saved there, and its
margin is 0 without compression.

Defined cases: null and wordless texts have no windows and get the score of no margin; labels
without a document, and null labels, are left out; rows with equal ids all count; without any
toxic or any ordinary training row every score is next to 0; an empty table gives no rows; extra columns
are kept by ``without_toxic`` and ignored by ``scores``.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.text import _BASE, _BASE_INVERSE, _BYTE_VALUES, Words, cuts, give_back, mix, powers, words

FOLDS = 5
TRAIN_ROWS = 6000
TRAIN_BYTES = 32 << 10
WINDOWS = (2, 8)  # words of short and of long windows, which start half a window apart
ODDS = 4  # times as many toxic as ordinary texts must hold a run, measured by the size of the classes
SHARED = (6, 8)  # bytes in a row that a window must share with the dictionary of either choice
CHANCES = (1e-6, 1e-2)  # of a run being as toxic as it looks without any bearing on toxicity
RUNS = (6, 12, 20)  # bytes of the runs that are counted; the first is the shortest match
RUN = RUNS[0]
COPY_RUN = 40  # bytes of the runs by which near copies are told
COPY_HASHES = 6
GAP = 8  # bytes that a passage may run over
PARTS = 3
TOXIC_BYTES = 64 << 10
ORDINARY_BYTES = 16 << 10
ORDINARY_SAMPLES = 40_000
SAMPLE_BYTES = 48
THRESHOLDS = (2, 3, 4, 5, 6, 8, 10, 13)
RIDGE = 10.0
SLICE_BYTES = 1 << 20


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        9, window_log=18, hash_log=16, chain_log=16, min_match=RUN,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings)


def _run_codes(data: np.ndarray, width: int) -> np.ndarray:
    """Every run of ``width`` bytes, eight at most, as a number."""
    n = max(0, len(data) - width + 1)
    code = np.zeros(n, np.uint64)
    for at in range(width):
        code = (code << np.uint64(8)) | data[at:at + n].astype(np.uint64)
    return code


@dataclass
class Windows:
    """Windows of some texts: their bytes, and how many each text has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_ends: np.ndarray


def _windows(found: Words, width: int = 8) -> Windows:
    """Windows of ``width`` words, joined by one blank and with a blank on either side."""
    sizes = found.ends - found.starts
    at = np.cumsum(sizes + 1) - sizes  # the first byte of each word, after its blank
    data = np.full(int(sizes.sum()) + len(sizes) + 1, 32, np.uint8)
    places = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    data[places + np.repeat(at, sizes)] = found.data[places + np.repeat(found.starts, sizes)]
    n = np.diff(found.text_ends, prepend=0)
    step = width // 2
    count = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
    begin = np.repeat(found.text_ends - n, count)
    begin += (np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)) * step
    end = np.minimum(begin + width, np.repeat(found.text_ends, count)) - 1
    return Windows(data, at[begin] - 1, at[end] + sizes[end] + 1, np.cumsum(count))


def _total(values: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of each text's values."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[ends - n]


@dataclass
class Model:
    """Dictionary contents, feature scaling and regression weights; small and picklable."""

    toxic: list[bytes]  # from the strictest choice of passages to the widest
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def _prepare(self) -> None:
        if "_plain" not in self.__dict__:
            self._plain = _compressor(self.ordinary)
            self._toxic = []
            for content, width in zip(self.toxic, SHARED):
                runs = np.unique(_run_codes(np.frombuffer(content, np.uint8), width))
                marks = np.zeros(1 << 20, bool)
                marks[(mix(runs) >> np.uint64(44)).astype(np.int64)] = True
                self._toxic.append((_compressor(content + self.ordinary), runs, marks))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def margins(self, found: Windows) -> np.ndarray:
        """Bytes that each toxic dictionary saves in each window; a row per dictionary."""
        self._prepare()
        margins = np.zeros((len(self.toxic), len(found.starts)), np.int64)
        raw = found.data.tobytes()
        # No match is looked for in the last bytes of an input, and the first one costs extra.
        anchor, sizes = self.ordinary[-24:], {}
        for row, ((compressor, runs, marks), width) in enumerate(zip(self._toxic, SHARED)):
            codes = _run_codes(found.data, width)
            at = np.flatnonzero(marks[(mix(codes) >> np.uint64(44)).astype(np.int64)])
            at = at[np.isin(codes[at], runs)]
            shared = np.searchsorted(at, found.starts) < np.searchsorted(at, found.ends - width, "right")
            saved: dict[bytes, int] = {}
            for window in np.flatnonzero(shared).tolist():
                content = raw[found.starts[window]:found.ends[window]]
                margin = saved.get(content)
                if margin is None:
                    whole = content + anchor
                    if content not in sizes:
                        sizes[content] = len(self._plain.compress(whole))
                    margin = saved[content] = sizes[content] - len(compressor.compress(whole))
                margins[row, window] = margin
        return margins

    def features(self, texts: pa.Array) -> np.ndarray:
        """Counts of margins from each threshold on and their summary, a row per text."""
        found = words(texts)
        columns = [np.log1p(np.diff(found.text_ends, prepend=0))]
        for width in WINDOWS:
            windows = _windows(found, width)
            ends = windows.text_ends
            n = np.diff(ends, prepend=0)
            some = np.flatnonzero(n)
            for margins in self.margins(windows):
                most = np.zeros(len(n))
                if len(some):
                    most[some] = np.maximum.reduceat(margins, (ends - n)[some])
                counts = [_total(margins >= k, n, ends) for k in THRESHOLDS]
                columns += [most, *(np.log1p(c) for c in counts), *(np.log((c + 0.3) / (n + 10)) for c in counts)]
                columns.append(_total(np.maximum(margins, 0), n, ends) / np.maximum(n, 1))
        return np.stack(columns, axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        scaled = (self.features(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(scaled @ self.weights[:-1] + self.weights[-1], -30, 30)))


FEATURES = len(WINDOWS) * len(CHANCES) * (2 * len(THRESHOLDS) + 2) + 1


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the run of ``width`` bytes from each place on."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(_BASE, len(data)), out=sums[1:])
    n = max(0, len(data) - width + 1)
    return mix((sums[width:width + n] - sums[:n]) * powers(_BASE_INVERSE, len(data))[:n])


def _inner(text: np.ndarray, width: int) -> np.ndarray:
    """Places whose run of ``width`` bytes lies in one text."""
    n = max(0, len(text) - width + 1)
    return np.flatnonzero(text[:n] == text[width - 1:width - 1 + n])


def _groups(texts: list[bytes], label: np.ndarray) -> np.ndarray:
    """Number of the group of each text: texts of a class that share a least hash of ``COPY_RUN`` bytes.

    Near copies would count as independent witnesses for whatever they share.
    """
    head = np.arange(len(texts))

    def root(at: int) -> int:
        while head[at] != at:
            head[at] = head[head[at]]
            at = int(head[at])
        return at

    first: dict[tuple, int] = {}
    for at, (text, own) in enumerate(zip(texts, label.tolist())):
        hashes = _rolling(np.frombuffer(text, np.uint8), COPY_RUN) if len(text) >= COPY_RUN else np.zeros(0, np.uint64)
        for seed in range(COPY_HASHES if len(hashes) else 0):
            least = int(mix(hashes ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)).min())
            other = first.setdefault((own, seed, least), at)
            head[root(at)] = root(other)
    _, group = np.unique([root(at) for at in range(len(texts))], return_inverse=True)
    return group


@dataclass
class Sample:
    """Distinct training texts (words joined by one blank) and the runs of bytes that toxic ones hold.

    Texts are counted by groups of near copies.
    """

    texts: list[bytes]  # toxic ones first, and group by group
    toxic: np.ndarray
    group: np.ndarray
    part: np.ndarray  # of each text; groups take turns, class by class
    data: np.ndarray  # bytes of the toxic texts, and which text they are of
    owner: np.ndarray
    codes: list[np.ndarray]  # by length of run: number of the run at each place of ``data``, or -1
    counts: list[np.ndarray]  # by length: groups that hold a run, by class and part

    @classmethod
    def of(cls, texts: pa.Array, toxic: np.ndarray) -> Sample:
        plain: dict[tuple[bytes, int], None] = {}  # copies count once
        for begin, size in cuts(texts, SLICE_BYTES):
            found = _windows(words(texts.slice(begin, size)))
            raw, last = found.data.tobytes(), 0
            for at, end in enumerate(found.text_ends.tolist()):
                own = raw[found.starts[last]:found.ends[end - 1]] if end > last else b""
                plain[own, int(toxic[begin + at])] = None
                last = end
        rows, label = [own for own, _ in plain], np.array([label for _, label in plain])
        group = _groups(rows, label)
        order = np.lexsort((group, -label))
        rows, label, group = [rows[at] for at in order.tolist()], label[order], group[order]
        first = np.flatnonzero(np.diff(group, prepend=-1) != 0)
        turn = np.cumsum(np.diff(group, prepend=-1) != 0) - 1
        part = (turn - np.where(label == 1, 0, int((label[first] == 1).sum()))) % PARTS
        n = int(label.sum())
        data = np.frombuffer(b"".join(rows[:n]), np.uint8)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(own) for own in rows[:n]])
        codes, counts = [], []
        for width in RUNS:
            at = _inner(owner, width)
            values, code = np.unique(_rolling(data, width)[at], return_inverse=True)
            pairs = np.unique(code.astype(np.int64) * (turn[-1] + 1) + turn[owner[at]])
            run, whose = np.divmod(pairs, turn[-1] + 1)
            # A run of one toxic group alone tells nothing.
            often = np.bincount(run, minlength=len(values)) > 1
            number = np.where(often, np.cumsum(often) - 1, -1)
            place = np.full(len(data), -1, np.int32)
            place[at] = number[code]
            codes.append(place)
            wanted = values[often]
            held = np.zeros((2, PARTS, len(wanted)), np.int64)
            kept = often[run]
            np.add.at(held, (1, part[first[whose[kept]]], number[run[kept]]), 1)
            for begin, end in _runs_of_groups(rows, turn, n):
                found, text = _occurrences(rows, begin, end, width, wanted)
                pairs = np.unique(found * (turn[-1] + 1) + turn[text])
                run, whose = np.divmod(pairs, turn[-1] + 1)
                np.add.at(held, (0, part[first[whose]], run), 1)
            counts.append(held)
        return cls(rows, label, group, part, data, owner, codes, counts)

    def passages(self, parts: list[int], chance: float) -> list[bytes]:
        """Stretches of the toxic texts of some parts in runs that are toxic by contrast."""
        used = np.isin(self.part, parts)
        share = len(set(self.group[used & (self.toxic == 1)])) / max(1, len(set(self.group[used])))
        marked, inside = np.zeros(len(self.data), bool), used[self.owner]
        known = np.zeros(len(self.data), np.int8)  # bytes of the telling run that starts here
        for width, place, held in zip(RUNS, self.codes, self.counts):
            if not held.shape[2]:
                continue
            ordinary, toxic = held[:, parts].sum(axis=1)
            ratio = (toxic + 0.5) / (ordinary + 0.5) * (1 - share) / share
            telling = (_tail(toxic, ordinary + toxic, share) < chance) & (ratio >= ODDS)
            at = np.flatnonzero((place >= 0) & inside)
            at = at[telling[place[at]]]
            # Runs that hold a shorter telling one say nothing new.
            short = np.zeros(len(at), bool)
            for step in range(width - RUN + 1):
                size = known[np.minimum(at + step, len(known) - 1)]
                short |= (size > 0) & (size <= width - step)
            known[at[~short]] = width
            at = at[~short]
            # A run that reaches beyond a passage is rarer than those within it.
            times = np.zeros(len(place) + 2 * width, np.int64)
            times[at + width] = toxic[place[at]]
            most = np.max([times[at + width + step] for step in range(1 - width, width)], axis=0, initial=0)
            at = at[2 * toxic[place[at]] >= most]
            for step in range(width):
                marked[at + step] = True
        places = np.flatnonzero(marked)
        step, other = np.diff(places), np.diff(self.owner[places]) != 0
        joined = np.split(places, np.flatnonzero((step > GAP) | other) + 1) if len(places) else []
        raw, found = self.data.tobytes(), []
        times = Counter(raw[part[0]:part[-1] + 1] for part in joined)
        for part in joined:
            whole = times[raw[part[0]:part[-1] + 1]] > 1
            for each in [part] if whole else np.split(part, np.flatnonzero(np.diff(part) > 1) + 1):
                found.append(raw[each[0]:each[-1] + 1])
        return found


def _runs_of_groups(rows: list[bytes], turn: np.ndarray, begin: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``SLICE_BYTES`` from a place on, each of whole groups."""
    size, start = 0, begin
    for at in range(begin, len(rows)):
        size += len(rows[at])
        if at + 1 == len(rows) or (size >= SLICE_BYTES and turn[at + 1] != turn[at]):
            yield start, at + 1
            size, start = 0, at + 1


def _occurrences(
    rows: list[bytes], begin: int, end: int, width: int, wanted: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes of runs (sorted) in some texts: which hash, and which text."""
    if not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(rows[begin:end]), np.uint8)
    text = np.repeat(np.arange(begin, end), [len(own) for own in rows[begin:end]])
    at = _inner(text, width)
    hashes = _rolling(data, width)[at]
    found = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    same = wanted[found] == hashes
    return found[same].astype(np.int64), text[at[same]]


def _tail(hits: np.ndarray, trials: np.ndarray, share: float) -> np.ndarray:
    """Chernoff bound of the chance of so many hits in so many trials."""
    rate = np.clip(hits / np.maximum(trials, 1), 1e-12, 1 - 1e-12)
    distance = rate * np.log(rate / share) + (1 - rate) * np.log((1 - rate) / (1 - share))
    return np.where(rate > share, np.exp(-trials * distance), 1.0)


def _trained(samples: list[bytes], most: int, segment: int) -> bytes:
    """Content of a zstandard dictionary trained on samples in segments of so many bytes."""
    size = min(most, max(256, sum(map(len, samples))))
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on
        return b""


def _toxic_dictionary(passages: list[bytes]) -> bytes:
    """A dictionary trained on the passages, and in front of it those that the training has left out.

    The training covers frequent byte runs first. Passages that are not in it whole follow by their
    number, as far as ``TOXIC_BYTES`` go.
    """
    trained = _trained(passages, TOXIC_BYTES // 2, 16)
    rest = [passage for passage, _ in Counter(passages).most_common() if passage not in trained]
    return b"".join(reversed(rest))[-(TOXIC_BYTES - len(trained)):] + trained


def _dictionaries(sample: Sample, parts: list[int]) -> tuple[list[bytes], bytes]:
    """The toxic dictionaries and the ordinary one from some parts of the sample."""
    toxic = [_toxic_dictionary(sample.passages(parts, chance)) for chance in CHANCES]
    chosen = np.flatnonzero(np.isin(sample.part, parts) & (sample.toxic == 0))
    ordinary = [sample.texts[at] for at in chosen.tolist()]
    places = [(at, begin) for at, text in enumerate(ordinary) for begin in range(0, len(text), SAMPLE_BYTES)]
    order = np.random.default_rng(0).permutation(len(places))[:ORDINARY_SAMPLES]
    windows = [ordinary[at][begin:begin + SAMPLE_BYTES] for at, begin in (places[place] for place in order)]
    ordinary = _trained(windows, ORDINARY_BYTES, 40) or b"".join(windows)[-ORDINARY_BYTES:]
    return toxic, ordinary.rjust(32)


def _fit(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([features, np.ones(len(features))])
    ridge = RIDGE * np.ones(x.shape[1])
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - toxic) + ridge * w
        )
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(texts: list[str], toxic: list[int]) -> Model:
    """Dictionaries and thresholds from labelled texts."""
    labels = np.array(toxic, dtype=np.int64)
    array = pa.array(texts, pa.string())
    if not labels.any() or labels.all():
        weights = np.zeros(FEATURES + 1)
        weights[-1] = -np.inf
        return Model([b""] * len(CHANCES), b" " * 32, np.zeros(FEATURES), np.ones(FEATURES), weights)
    sample = Sample.of(array, labels)
    give_back()
    features = np.zeros((len(sample.texts), FEATURES))
    for number in range(PARTS):
        apart, rest = np.flatnonzero(sample.part == number), sample.toxic[sample.part != number]
        if len(apart) and 0 < rest.sum() < len(rest):
            model = Model(*_dictionaries(sample, [other for other in range(PARTS) if other != number]), 0, 1, np.zeros(0))
            own = pa.array([sample.texts[at].decode("utf-8", "replace") for at in apart.tolist()], pa.string())
            features[apart] = np.concatenate([model.features(own.slice(b, n)) for b, n in cuts(own, SLICE_BYTES)])
    mean, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    weights = _fit((features - mean) / scale, sample.toxic)
    return Model(*_dictionaries(sample, list(range(PARTS))), mean, scale, weights)


def fold(doc_id: Column) -> Column:
    """The fold a row belongs to; fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample (``text``, ``toxic``) outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(*order, "toxic").limit(TRAIN_ROWS)
    short = F.octet_length("text") <= TRAIN_BYTES
    # The limit bounds what is broadcast.
    both = docs.select("doc_id", "text").where(short).join(F.broadcast(chosen), "doc_id")
    return both.orderBy(*order, "text").limit(TRAIN_ROWS).select("text", "toxic")


def train_on(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the bounded sample, fitted in one task; the driver gets the finished model."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            toxic += batch.column(1).to_pylist()
        model = pickle.dumps(train(texts, toxic))
        texts.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    fitted = training_rows(docs, labels).coalesce(1).mapInArrow(fit, "model binary").collect()
    # No partition, no task: there is no labelled row then.
    return pickle.loads(fitted[0].model) if fitted else train([], [])


def toxicity(text: Column, model: Model) -> Column:
    """Score of a text column."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.scores(texts.slice(b, n)) for b, n in cuts(texts, SLICE_BYTES)]
        give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document; ``predicted`` is 1 from 0.5 on."""
    model = train_on(docs, labels)
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are not predicted toxic."""
    model = train_on(docs, labels)
    return docs.where(toxicity(docs["text"], model) < 0.5)
