"""Tries against counters; collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import collocations as module
from wardlake.llm.collocations import HatTrie, Table, collocations, merged, pack, unpack


def expected(rows, least, longest=5, top=2000, covered=100):
    counts = {}
    for _, text, lang in rows:
        own = counts.setdefault(lang or "und", Counter())
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            for size in range(1, longest + 1):
                own.update(tuple(words[at:at + size]) for at in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        n = sum(f for phrase, f in own.items() if len(phrase) == 1)
        candidates = {phrase: f for phrase, f in own.items() if len(phrase) > 1 and f >= least}
        found = []
        for phrase, a in candidates.items():
            if any(
                len(other) > len(phrase) and 100 * f >= covered * a
                and any(other[at:at + len(phrase)] == phrase for at in range(len(other)))
                for other, f in candidates.items()
            ):
                continue
            score, k = min(
                (1000 * a * n // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase))
            )
            found.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["The", "of", "naïve", "größe", "data", "x|y", "中文", "a", "\x00", "É"]
    fixed = ["New York City", "of the data of the data", "a a a a a a a", "to be or not to be"]
    rows = []
    for number in range(n):
        parts = [rng.choice(words) if rng.random() < 0.6 else rng.choice(fixed) for _ in range(rng.randrange(30))]
        text = "".join(part + rng.choice([" ", " ", "  ", "\t", ". ", ", ", "\n", "!"]) for part in parts)
        rows.append((number, text, rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("least,longest,top,covered", [(3, 5, 2000, 100), (2, 5, 7, 100), (4, 3, 50, 60), (3, 2, 9, 100)])
def test_same_as_counting(documents, least, longest, top, covered):
    rows = corpus(1) + [(900, None, "en"), (901, "", None), (1, "New York City", "en")]
    made = collocations(documents(rows, ", lang string"), least, longest, top, covered)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, made.collect())) == expected(rows, least, longest, top, covered)


def test_spilled_runs_merge(monkeypatch):
    """Tables that burst, and half of the trie spilled after every batch."""
    monkeypatch.setattr(module, "BURST", 4)
    rng = np.random.default_rng(1)
    trie, whole, runs = HatTrie(3), Counter(), {}
    for _ in range(30):
        grams = rng.integers(0, 8, (200, 3)).astype(np.uint64) << np.uint64(61)
        grams, counts = np.unique(grams, axis=0, return_counts=True)
        trie.add(grams, counts)
        whole.update({tuple(gram): int(f) for gram, f in zip(grams.tolist(), counts)})
        assert any(isinstance(child, list) for child in trie.root)
        for prefix, run in trie.spill(len(trie) // 2, 9):
            runs.setdefault(prefix, []).append(unpack(run, False))
    for prefix, run in trie.spill(0, 9):
        runs.setdefault(prefix, []).append(unpack(run, False))
    assert len(trie) == 0 and len(runs) > 4
    found = Counter()
    for prefix, parts in runs.items():
        for grams, counts, _ in parts:
            assert (grams[np.lexsort(tuple(reversed(grams.T)))] == grams).all()
        grams, counts, _ = merged(parts)
        assert set(trie.prefix(grams, 9).tolist()) == {prefix}
        assert not any(tuple(gram) in found for gram in grams.tolist())
        found.update({tuple(gram): int(f) for gram, f in zip(grams.tolist(), counts)})
    assert found == whole


@settings(max_examples=50, deadline=None)
@given(st.lists(st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 9)), st.integers(1, 5)), max_size=6))
def test_table_counts(batches):
    table, whole = Table(2, True, 2), Counter()
    for batch in batches:
        grams = np.array(list(batch), np.uint64).reshape(-1, 2)
        names = np.empty(len(batch), object)
        names[:] = [bytes(gram) for gram in batch]
        table.add(grams, np.array(list(batch.values()), np.int64), names)
        whole.update(batch)
    grams, counts, names = table.entries()
    assert dict(zip(map(tuple, grams.tolist()), counts.tolist())) == whole
    assert [bytes(gram) for gram in grams.tolist()] == list(names)
    back = unpack(pack(grams, counts, names), True)
    assert (back[0] == grams).all() and (back[1] == counts).all() and list(back[2]) == list(names)


def test_long_text_in_parts(documents, monkeypatch):
    text = corpus(2, 1)[0][1] + " of the data. of the data" * 500 + " word" * 300
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(module, "PIECE", 64)
    parts = [part.tobytes() for part, _ in module._parts(data, np.array([0, len(data)]))]
    assert len(parts) > 50 and b"".join(parts) == text.encode()
    assert all(part[:1] == b"." or at == 0 or part[:1] in b",;:!?\n" for at, part in enumerate(parts))
    rows = [(1, text, "en")]
    made = collocations(documents(rows, ", lang string"), 5)
    assert sorted(map(tuple, made.collect())) == expected(rows, 5)


def test_products_beyond_64_bits(spark):
    """The score's division is exact beyond 64 bits."""
    a = 3_000_000_019
    row = spark.sql(
        f"SELECT (cast(1000 AS decimal(4,0)) * (cast({a}L AS decimal(18,0)) * cast({a * 7}L AS decimal(18,0))))"
        f" div (cast({a}L AS decimal(18,0)) * cast(13 AS decimal(18,0))) AS score"
    ).first()
    assert row.score == 1000 * a * a * 7 // (a * 13)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "too few words", "en")]])
def test_nothing(documents, rows):
    assert collocations(documents(rows, ", lang string")).collect() == []


def test_clashing_columns(documents):
    docs = documents([(n, "new york", "en", 1, 2, "x") for n in range(4)], ", lang string, n long, k long, `a.b` string")
    assert [row.phrase for row in collocations(docs, 3).collect()] == ["new york"]
