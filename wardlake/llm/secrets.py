"""Secret scan: base patterns, and guess costs of values in a credential context.

Base findings are assignments of passwords and tokens, access key ids and long hex strings. The
method adds values that stand in a wider credential context (``pwd is ...``, ``Bearer ...``) and
are hard to guess: a dynamic program splits the value into words, dates, repeats, keyboard walks
and brute-force spans so that the product of the spans' guesses is least, and a value counts from
``MIN_GUESSES`` (log10) on. ``changeme2024`` costs little, ``x9$Kq2!vT`` much. The cost of base
assignments' values is returned as well.

Words are ranked by their frequency in the corpus itself (``learn_words``): letters that stand outside of
credential values are counted over all whole texts, combined in the task and before the shuffle. The list
that goes to the tasks holds the ``WORDS`` most frequent words that occur at least ``LEAST`` times, after a
few that are common in passwords everywhere; other words are priced like random letters.

Each text is one row's work and its spans are its only result; nothing but word counts is shuffled. The
program takes time in proportion to the value's length, as no span but brute force is longer
than ``LONGEST``, and a longer repeat or walk only begins where it begins.

Defined cases: null is empty and has no spans; positions are code points, ends exclusive; spans of
one kind never overlap, spans of different kinds may; rows with equal ids are scanned each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
MIN_GUESSES = 8.0
LONGEST = 24
SHORTEST = 3  # characters of a word, a repeat or a walk
WORDS = 50_000
LEAST = 5
TASK_WORDS = 1 << 20  # distinct words that a task counts before it sends them on

ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
# A match of the open pattern is a whole run of its last class, so its least length can stand in
# the pattern itself.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"(?i:\b(?:pwd|pass(?:word|wd|phrase|code)?|secret|token|api[_-]?key|credentials?|bearer"
    r"|(?:private|access|client)[_-]?(?:key|secret))[\"']?(?:\x20*(?:[:=]|=>)\x20*|\x20+is\x20+|(?<=bearer)\x20+))"
    r"[\"']?([^\s\"'<>]{6,})",
    re.ASCII,
)
# Every match of ASSIGN or CONTEXT holds one of these in lower case: a fast look before the patterns.
_SIGNS = ("pwd", "pass", "secret", "token", "api_key", "api-key", "apikey", "credential", "bearer",
          "private", "access", "client")
_TRAILING = ",.;:!?)]}|"

# Words that are common in passwords, by rank.
COMMON_WORDS = (
    "password admin welcome love dragon monkey master login letmein qwerty princess sunshine"
    " football baseball shadow superman michael ninja mustang access hello freedom whatever"
    " trust secret summer winter spring autumn flower charlie soccer hockey killer george"
    " computer internet server user guest root test demo default change changeme temp pass"
    " example sample token key none null true false public private system service data base"
    " january february march april may june july august september october november december"
    " monday tuesday wednesday thursday friday saturday sunday red green blue black white"
    " happy money family music apple orange banana coffee house home work office company"
).split()
_RANK = {word: rank for rank, word in enumerate(COMMON_WORDS, 1)}
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}
_LETTERS = re.compile(r"[a-z]+")
# Substitutions undone before words are looked up, and rows of a keyboard.
_LEET = str.maketrans("@4301!$57", "aaeoiissT".lower())
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {key: (x + 0.5 * y, y) for y, row in enumerate(_ROWS) for x, key in enumerate(row)}
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)


def _alphabet(char: str) -> int:
    if char.isdigit():
        return 10
    if char.isalpha() and char.isascii():
        return 26
    return 33 if char.isascii() else 100


def _beside(a: str, b: str) -> bool:
    """Neighbours on the keyboard, or next to each other in the alphabet."""
    if a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return True
    if a in _PLACE and b in _PLACE and a != b:
        (x, y), (u, v) = _PLACE[a], _PLACE[b]
        return abs(y - v) <= 1 and abs(x - u) <= 1
    return False


def _word_price(text: str, rank: int, undone: bool) -> float:
    upper = sum(c.isupper() for c in text)
    forms = 1 if not upper else 2 if upper in (1, len(text)) else 2 ** min(upper, len(text) - upper)
    return math.log10(rank * forms * (4 if undone else 1) + 1)


def _step(a: str, b: str):
    """Direction from one key to the next, in the alphabet or on the keyboard."""
    step = ord(b) - ord(a)
    if abs(step) != 1 and a in _PLACE and b in _PLACE:
        return (_PLACE[b][0] - _PLACE[a][0], _PLACE[b][1] - _PLACE[a][1])
    return step


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses that the cheapest segmentation needs.

    The segments' guesses multiply; each segment but the first doubles them, for the attacker has
    to find the split too. Characters guessed by brute force multiply theirs without such a price.
    """
    n, low = len(value), value.translate(_LOWER)  # A-Z only: every character keeps its place
    plain = low.translate(_LEET)
    another = math.log10(2)
    best = [0.0] + [math.inf] * n
    # Begins of the repeat and of the walk that run up to each character, and turns of the walk so far.
    repeat, walk, turns = 0, 0, [0] * n
    for i in range(n):
        if i and low[i] != low[i - 1]:
            repeat = i
        if i and not _beside(low[i - 1], low[i]):
            walk = i
        if i >= 2:
            turns[i - 1] = turns[i - 2] + (_step(low[i - 1], low[i]) != _step(low[i - 2], low[i - 1]))
        for end, price in _ends(value, low, plain, i, ranks):
            best[end] = min(best[end], best[i] + (another if i else 0) + price)
        best[i + 1] = min(best[i + 1], best[i] + math.log10(_alphabet(value[i])))
        for begin, per in ((repeat, False), (walk, True)):
            last = i - SHORTEST + 1
            near = range(max(begin, i - LONGEST + 1), last + 1)
            for j in (near if begin in near or begin > last else (begin, *near)):
                size = i - j + 1
                if per:
                    price = math.log10(47 * size) + 0.5 * (turns[i - 1] - turns[j])
                else:
                    price = math.log10(_alphabet(value[i]) * size)
                best[i + 1] = min(best[i + 1], best[j] + (another if j else 0) + price)
    return best[n]


def _ends(value: str, low: str, plain: str, i: int, ranks: dict[str, int]) -> Iterator[tuple[int, float]]:
    """Ends and prices of the words and the date that begin at a place."""
    for j in range(i + SHORTEST, min(len(value), i + LONGEST) + 1):
        rank = ranks.get(low[i:j])
        undone = rank is None and (rank := ranks.get(plain[i:j])) is not None
        if rank is not None:
            yield j, _word_price(value[i:j], rank, undone)
    found = _DATE.match(value, i)
    if found:
        days = 120 if found.end() - i == 4 else 365 * 120 * (4 if found[1] or found[2] else 1)
        yield found.end(), math.log10(days)


def find_spans(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[int, int, str, float | None]]:
    """Spans of a text in order: start, end, kind, and the value's guess cost in a context."""
    spans = []
    base: set[tuple[int, int]] = set()
    low = text.lower()
    credentials = any(sign in low for sign in _SIGNS)
    for found in ASSIGN.finditer(text) if credentials else ():
        if found.end(1) - found.start(1) >= 6:
            spans.append((found.start(), found.end(), "assign", guess_cost(found[1], ranks)))
            base.add(found.span(1))
    spans += [(*found.span(), "access", None) for found in ACCESS.finditer(text)]
    spans += [(*found.span(), "hex", None) for found in HEX.finditer(text)]
    for found in CONTEXT.finditer(text) if credentials else ():
        value = found[1].rstrip(_TRAILING)
        start, end = found.start(1), found.start(1) + len(value)
        if len(value) < 6 or any(b <= start and end <= e for b, e in base):
            continue  # what a base assignment already holds
        cost = guess_cost(value, ranks)
        if cost >= MIN_GUESSES:
            spans.append((start, end, "guess", cost))
    return sorted(spans, key=lambda span: (span[0], KINDS.index(span[2]), span[1]))


_SPANS = pa.list_(pa.struct([
    ("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("guesses", pa.float64()),
]))


def learn_words(docs: DataFrame, most: int = WORDS, least: int = LEAST) -> dict[str, int]:
    """Ranks of the corpus's words, which follow those of ``COMMON_WORDS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            rows = [(word, n) for word, n in counts.items() if SHORTEST <= len(word) <= LONGEST]
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0] for row in rows], pa.string()), pa.array([row[1] for row in rows], pa.int64())],
                ["word", "n"],
            )

        for batch in batches:
            for text in batch.column(0):
                low = (text.as_py() or "").lower()
                if any(sign in low for sign in _SIGNS):
                    # What may be a credential is no word of the language.
                    low = CONTEXT.sub(" ", ASSIGN.sub(" ", low))
                counts.update(_LETTERS.findall(low))
                if len(counts) > TASK_WORDS:
                    yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chosen = counted.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(most).select("word").collect()
    ranks = dict(_RANK)
    for row in chosen:
        ranks.setdefault(row.word, len(ranks) + 1)
    return ranks


def find_secrets(docs: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """Per row: ``doc_id`` and its ``spans`` in order, with the guess cost where there is one.

    Words are ranked by ``docs`` unless ``ranks`` are given.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(learn_words(docs) if ranks is None else ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "begin": b, "end": e, "guesses": g}
                 for b, e, k, g in find_spans(t.as_py() or "", ranks.value)]
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(spans, _SPANS)], names=["doc_id", "spans"]
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "array<struct<kind: string, begin: int, end: int, guesses: double>>"
    return chosen.mapInArrow(scan, f"doc_id long, spans {kind}")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))
    ))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    spans = F.col("spans")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"] != KINDS[-1])
    return find_secrets(docs).select(
        "doc_id", *(count(kind) for kind in KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
    )


def masked(docs: DataFrame, mark: str = "[secret]", ranks: dict[str, int] | None = None) -> DataFrame:
    """Rows of ``docs`` with every span of the text replaced by ``mark``; all columns are kept."""
    ranks = docs.sparkSession.sparkContext.broadcast(learn_words(docs) if ranks is None else ranks)

    def hidden(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for begin, end, _, _ in find_spans(text, ranks.value):
            if end > at:
                if begin >= at:
                    parts += [text[at:begin], mark]
                at = end
        return "".join([*parts, text[at:]])

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([hidden(text.as_py()) for text in texts], pa.string())

    return docs.withColumn("text", mask("text"))
