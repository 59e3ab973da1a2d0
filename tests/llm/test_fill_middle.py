"""Cuts by the exception index against Python strings; examples and their restoration."""

import hashlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlake.llm.fill_middle import ExceptionIndex, fill_in_middle, restored


@given(st.lists(st.text(alphabet="ab\x00é€😀́中", max_size=40), max_size=5))
def test_cuts_convert_both_ways(texts):
    joined = "".join(texts)
    index = ExceptionIndex.of(np.frombuffer(joined.encode(), np.uint8))
    points = np.arange(len(joined) + 1)
    offsets = np.array([len(joined[:point].encode()) for point in points])
    assert index.to_bytes(points).tolist() == offsets.tolist()
    assert index.to_points(offsets).tolist() == points.tolist()


def test_ascii_has_no_entries():
    assert len(ExceptionIndex.of(np.frombuffer(b"plain text", np.uint8)).points) == 0


def expected(doc_id, text):
    """The example by Python's own code points."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    draws = [int(digest[at:at + 8], 16) for at in range(0, 32, 8)]
    if not text or any(marker in text for marker in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= 90:
        return (doc_id, len(text), "plain", None, None, text)
    low, high = sorted(draw % (len(text) + 1) for draw in draws[:2])
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if draws[3] % 100 < 20:
        return (doc_id, len(text), "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, len(text), "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}")


TEXTS = [
    "", None, "a", "é", "plain words only", "naïve café 😀 中文 text", "holds <P> already", "<S>", "<M", "<S<P",
    "<<<", ">P>", "x" * 300_000, "中😀é" * 50_000, "\x00\n\t", "é" * 20, "two\nlines",
]


def test_examples(spark, documents):
    rows = [(number, text) for number in range(12) for text in TEXTS] + [(None, "no id"), (3, TEXTS[5])]
    made = fill_in_middle(documents(rows))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = sorted((tuple(row) for row in made.collect()), key=repr)
    assert found == sorted((expected(*row) for row in rows), key=repr)
    assert {row[2] for row in found} == {"plain", "psm", "spm"}


def test_restored(documents):
    rows = [(number, text or "") for number in range(40) for text in TEXTS]
    made = fill_in_middle(documents(rows)).withColumn("text", restored(F.col("output"), F.col("form")))
    assert sorted((row.doc_id, row.text) for row in made.collect()) == sorted(rows)


def test_shares(documents):
    made = fill_in_middle(documents([(number, "some words") for number in range(400)]), 0, 100)
    assert {row.form for row in made.collect()} == {"spm"}


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_nothing(documents, rows):
    made = fill_in_middle(documents(rows))
    assert [row.output for row in made.collect()] == ["" for _ in rows]


def test_clashing_columns(documents):
    docs = documents([(1, "abc", 5, "form", "x")], ", n long, form string, `a.b` string")
    assert fill_in_middle(docs).count() == 1
