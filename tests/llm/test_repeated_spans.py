"""Removal of repeated strings against a plain search of every string."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import repeated_spans
from wardlake.llm.repeated_spans import parse, remove_repeats, suffix_classes


def expected(rows, length=100):
    """Per row: bytes, removed bytes, runs and what stays, from a table of all strings."""
    order = sorted(range(len(rows)), key=lambda at: (rows[at][0] is None, rows[at][0] or 0))
    seen, out = set(), []
    for at in order:
        doc_id, text = rows[at][:2]
        data = (text or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for start in range(len(data) - length + 1):
            string = data[start:start + length]
            if string in seen:
                gone[start + 1:start + 1 + length] = True
            seen.add(string)
        inner = gone[1:-1]
        kept = np.frombuffer(data, np.uint8)[~inner].tobytes()
        out.append((doc_id, len(data), int(inner.sum()), int((gone[1:] & ~gone[:-1]).sum()), kept))
    return out


def found(df):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect()]


def corpus(seed, n=60):
    """Documents with shared passages, copies, changed copies and periodic parts."""
    rng = random.Random(seed)
    words = ["the", "of", "naïve", "größe", "data", "spark", "line", "中文", "seven", "a"]

    def prose(size):
        return " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(size))

    passages = [prose(rng.randrange(10, 40)) for _ in range(5)]
    rows = []
    for number in range(n):
        kind = rng.randrange(6)
        text = prose(rng.randrange(0, 60))
        if kind < 3:
            text += rng.choice(passages)[:rng.randrange(80, 400)] + prose(5)
        if kind == 3 and rows:
            text = rng.choice(rows)[1]
        if kind == 4 and rows:
            at = rng.randrange(1 + len(text))
            other = rng.choice(rows)[1]
            text = other[:at] + "X" + other[at:]
        if kind == 5:
            text += "ab" * rng.randrange(40, 200) + "é" * rng.randrange(100)
        rows.append((number, text))
    rng.shuffle(rows)
    return rows


def test_same_as_search(documents):
    rows = corpus(1) + [(100, None), (101, ""), (102, "x" * 99), (103, "x" * 100), (104, "x" * 350)]
    made = remove_repeats(documents(rows))
    assert made.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert sorted(found(made)) == sorted(expected(rows))


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_triggers(documents, hot):
    rows = corpus(2)
    assert sorted(found(remove_repeats(documents(rows), hot=hot))) == sorted(expected(rows))


def test_over_many_tasks(documents):
    rows = corpus(3, 120)
    assert sorted(found(remove_repeats(documents(rows).repartition(7)))) == sorted(expected(rows))


def test_long_texts_come_in_pieces(documents, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(9000))
    rows = [(1, base + base[1000:3000]), (2, "head " + base[500:7000] + " tail"), (3, base[8000:])]
    monkeypatch.setattr(repeated_spans, "PIECE", 1 << 10)
    batches = list(repeated_spans._pieces(
        pa.RecordBatch.from_pydict({"text": [text for _, text in rows]}), 100))
    assert len(batches) > 15
    starts = set()
    for data, bounds, numbers, offsets in batches:
        phrases = parse(data, bounds)
        for first, last in zip(phrases.first, phrases.last):
            local = np.searchsorted(bounds, first, "right") - 1
            for start in range(first, last + 1):
                starts.add((numbers[local], start - bounds[local] + offsets[local]))
    assert len(starts) == sum(len(text) - 99 for _, text in rows)
    assert sorted(found(remove_repeats(documents(rows)))) == sorted(expected(rows))


def test_null_ids_and_repeated_rows(documents):
    text = corpus(5)[0][1] + "z" * 120
    made = found(remove_repeats(documents([(None, text), (1, text), (1, text), (2, "short"), (2, "short")])))
    size = len(text.encode())
    assert sorted(made, key=repr) == sorted(
        expected([(1, text)]) + [(1, size, size, 1, b"")] + [(None, size, size, 1, b"")]
        + [(2, 5, 0, 0, b"short")] * 2, key=repr,
    )


def test_same_id_other_texts(documents):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdef") for _ in range(150))
    made = found(remove_repeats(documents([(1, shared + "one"), (1, shared + "two")])))
    assert sorted(row[2] for row in made) == [0, 150]


def test_nothing(documents):
    assert found(remove_repeats(documents([]))) == []


def test_clashing_columns(documents):
    docs = documents([(1, "a" * 120, 5, 6, 7, "s")], ", id long, h long, start long, `a.b` string")
    assert [row[2] for row in found(remove_repeats(docs))] == [119]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.integers(2, 40))
def test_suffix_classes(raw, length):
    data = np.frombuffer(raw, np.uint8)
    starts = np.arange(max(0, len(raw) - length + 1))
    ranks = suffix_classes(data, starts, length) if len(starts) else starts
    strings = [raw[at:at + length] for at in starts]
    place = {string: rank for rank, string in enumerate(sorted(set(strings)))}
    assert ranks.tolist() == [place[string] for string in strings]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abé", max_size=260), max_size=4))
def test_equal_strings_share_their_trigger(texts):
    raw = [text.encode() for text in texts]
    bounds = np.cumsum([0, *map(len, raw)])
    phrases = parse(np.frombuffer(b"".join(raw), np.uint8), bounds, 40, 8)
    joined, triggers = b"".join(raw), {}
    covered = 0
    for first, last, trigger in zip(phrases.first, phrases.last, phrases.trigger):
        for start in range(first, last + 1):
            covered += 1
            assert triggers.setdefault(joined[start:start + 40], trigger) == trigger
    assert covered == sum(max(0, len(text) - 39) for text in raw)
