import hashlib
import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import quotient_filter as qf

prints = st.lists(st.integers(0, 2**20 - 1), max_size=200)


@settings(max_examples=200, deadline=None)
@given(prints, prints)
def test_filters_keep_counts_through_merges_and_bytes(a, b):
    one, two = (qf.CountingQuotientFilter.of(np.array(x, np.uint64), 20) for x in (a, b))
    merged = qf.CountingQuotientFilter.load(one.merge(two).dump())
    expected = Counter(a) + Counter(b)
    assert dict(zip(merged.prints().tolist(), merged.counts.tolist(), strict=True)) == expected
    asked = np.array([*a, 2**20 - 1, 0], np.uint64)
    assert merged.count(asked).tolist() == [expected[x] for x in asked.tolist()]
    run = merged.remainders  # sorted within runs: fingerprints come back in order
    assert (np.diff(merged.prints().astype(np.int64)) > 0).all() and len(run) == len(expected)


def test_repeated_fingerprints(spark):
    rng = random.Random(1)
    values = [rng.randrange(-2**63, 2**63) for _ in range(500)]
    all_values = values + values[:50] * 3 + [-1] * 1000
    df = spark.createDataFrame([(v,) for v in all_values], "fingerprint long").repartition(7)
    found = {r.fingerprint: r.copies for r in qf.repeated_fingerprints(df, slice_bits=4).collect()}
    assert found == {v: n for v, n in Counter(all_values).items() if n > 1}


def brute(docs):
    norm = {k: re.sub(r"[\x20\x09-\x0d]", "", t or "") for k, (_, t) in enumerate(docs)}
    out = []
    for k, (doc_id, text) in enumerate(docs):
        group = [(-len(t or ""), i is None, i or 0, i) for j, (i, t) in enumerate(docs) if norm[j] == norm[k]]
        keep = min(group)
        out.append((doc_id, keep[3], len(group), keep == (-len(text or ""), doc_id is None, doc_id or 0, doc_id),
                    hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=repr)


def test_duplicates_against_brute_force(spark, documents):
    rng = random.Random(2)
    docs = [(k, rng.choice(["a b", "ab", "a\tb ", "a\x0bb\r\n", "é", " é", "c d", "cd", "", " ", None]))
            for k in range(60)] + [(None, "ab"), (5, "ab"), (5, "ab"), (99, "x" * 500_000), (98, "x " * 500_000)]
    found = qf.exact_duplicates(documents(docs).repartition(5))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(docs)


def test_only_null_ids_and_clashing_columns(documents):
    docs = documents([(None, "a", "x"), (None, "a ", "y")], ", text_sha256 string")
    assert sorted((r.keep_id, r.kept) for r in qf.exact_duplicates(docs).collect()) == [(None, False), (None, True)]
    assert qf.exact_duplicates(documents([])).count() == 0
