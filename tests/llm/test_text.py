import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import text
from wardlake.llm.text import cuts, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9 éß.-\n漢", max_size=12)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    found = words(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, found.text_ends.tolist(), strict=True):
        own = [bytes(found.data[b:e]).decode() for b, e in zip(found.starts[begin:end], found.ends[begin:end])]
        assert own == plain_words(text)
        begin = end


def test_equal_words_have_equal_hashes_wherever_they_are():
    found = words(pa.array(["one two", "TWO x one"]))
    a, b, c, d, e = found.hashes.tolist()
    assert (a, b) == (e, c) and len({a, b, d}) == 3


def test_cuts_cover_all_rows_and_keep_long_ones_whole():
    texts = pa.array(["a" * 5, None, "b" * 100, "c", "d" * 9])
    assert list(cuts(texts, 10)) == [(0, 2), (2, 1), (3, 2)]
    assert list(cuts(pa.array([], pa.string()), 10)) == []


def test_powers_are_kept_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(text, "_KEPT", 1 << 12)
    monkeypatch.setattr(text, "_POWERS", {})
    for size in (1, 5, 3000, 4096, 5000):
        found = text.powers(np.uint64(3), size)
        assert len(found) == size and all(int(found[at]) == pow(3, at, 2**64) for at in {0, size // 2, size - 1})
    assert [len(kept) for kept in text._POWERS.values()] == [1 << 12]
