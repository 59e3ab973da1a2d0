import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import near_duplicates as nd


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


short = st.lists(st.integers(0, 4), max_size=20)


@settings(max_examples=400, deadline=None)
@given(short, short, st.integers(0, 22))
def test_banded_alignment_is_the_edit_distance(a, b, most):
    x, y = np.array(a, np.uint32), np.array(b, np.uint32)
    distance = slow_distance(a, b)
    assert nd.edit_distance(x, y, most) == (distance if distance <= most else None)
    assert nd.least_distance(x, y) <= distance


def test_order_matters_to_a_sketch():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2**63, 200, dtype=np.uint64)
    swapped = np.concatenate([text[100:], text[:100]])
    both = np.concatenate([text, swapped])
    _, keys = nd.band_keys(both, np.array([0, 200]), np.array([200, 400]))
    _, same = nd.band_keys(np.concatenate([text, text]), np.array([0, 200]), np.array([200, 400]))
    assert (same[0] == same[1]).all() and (keys[0] == keys[1]).mean() < 0.5


def test_occurrences_are_told_apart():
    labelled = nd.label_occurrences(np.array([0, 0, 0, 1]), np.array([5, 5, 5, 5], np.uint64))
    assert len(set(labelled[:3].tolist())) == 3 and labelled[3] == labelled[0]


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def groups_of(df):
    groups = {}
    for row in df.collect():
        groups.setdefault(row.class_id, set()).add(row.doc_id)
    return groups


def test_planted_copies_are_found_and_others_left_alone(spark, documents):
    rng = random.Random(4)
    rows, truth = [], []
    for base in range(12):
        original = words(rng, rng.choice([40, 120, 400]))
        ids = set()
        for copy in range(4):
            edited = list(original)
            for _ in range(copy * len(edited) // 120):
                edited[rng.randrange(len(edited))] = rng.choice("xyz")
            rows.append((base * 10 + copy, " ".join(edited)))
            ids.add(base * 10 + copy)
        truth.append(ids)
    alone = {1000 + k for k in range(40)}
    passage = words(rng, 60)
    rows += [(k, " ".join(words(rng, 80) + passage + words(rng, 80))) for k in alone]
    found = nd.near_duplicates(documents(rows))
    groups = groups_of(found)
    assert all(groups[min(ids)] == ids for ids in truth)
    assert all(groups[k] == {k} for k in alone)
    assert found.where("kept").count() == len(groups)


def test_chains_join_over_several_buckets(spark, documents):
    rng = random.Random(5)
    text, rows = words(rng, 100), []
    for k in range(12):  # each differs from the next in few words, the ends in many
        rows.append((k, " ".join(text)))
        for at in range(k * 6, k * 6 + 6):
            text[at] = rng.choice("pqr") + str(k)
    assert groups_of(nd.near_duplicates(documents(rows))) == {0: set(range(12))}


def test_a_large_group_of_variants_is_one_class(spark, documents):
    rng = random.Random(6)
    text = words(rng, 150)
    rows = []
    for k in range(300):
        edited = list(text)
        edited[rng.randrange(150)] = f"v{k}"
        rows.append((k, " ".join(edited)))
    assert groups_of(nd.near_duplicates(documents(rows))) == {0: set(range(300))}


def test_nulls_short_texts_ties_and_extra_columns(spark, documents):
    docs = documents(
        [(1, None, 1), (2, "", 1), (3, "one two", 1), (4, "One, two!", 1), (5, "one two three", 1), (None, "one two", 1), (3, "?", 1)],
        ", rid int",
    )
    found = nd.near_duplicates(docs)
    sizes = sorted(((r.doc_id, r.class_id, r.class_size) for r in found.collect()), key=repr)
    assert sizes == sorted(
        [(1, 1, 1), (2, 2, 1), (3, 3, 3), (4, 3, 3), (None, 3, 3), (5, 5, 1), (3, 3, 1)], key=repr)
    together = nd.near_duplicates(docs, wordless=True)
    assert {r.class_size for r in together.collect() if r.n_words == 0} == {3}
    assert nd.near_duplicates(documents([])).count() == 0


def test_one_row_of_each_class_stays_with_its_columns(spark, documents):
    docs = documents([(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "z")], ", rid string")
    kept = nd.without_near_duplicates(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def replaced(rng, text, n):
    """``text`` with exactly ``n`` words replaced by new ones at random places."""
    edited = list(text)
    for at in rng.sample(range(len(text)), n):
        edited[at] = f"new{rng.randrange(10**9)}"
    return edited


def test_recall_of_candidates_at_the_threshold():
    rng = random.Random(8)
    for length, similarity, least in [
        (200, 0.80, 0.93), (200, 0.85, 0.97), (200, 0.90, 0.99), (200, 0.95, 1), (1000, 0.80, 0.93), (70, 0.80, 0.93),
    ]:
        found = 0
        for _ in range(200):
            text = list(range(length))
            other = list(text)
            for at in rng.sample(range(length), round(length * (1 - similarity))):
                other[at] = rng.randrange(10**6, 10**9)
            hashes = nd.mix(np.array(text + other, np.uint64) + np.uint64(rng.randrange(2**60)))
            _, keys = nd.band_keys(hashes, np.array([0, length]), np.array([length, 2 * length]))
            found += bool((keys[0] == keys[1]).any())
        assert found >= least * 200, (length, similarity, found)


def test_pairs_at_the_threshold_are_linked(documents):
    rng = random.Random(9)
    rows, shares = [], [0.80, 0.85, 0.90, 0.95]
    for k in range(160):
        text = words(rng, 200)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(replaced(rng, text, round(200 * (1 - shares[k % 4])))))]
    groups = groups_of(nd.near_duplicates(documents(rows)))
    found = [groups.get(2 * k) == {2 * k, 2 * k + 1} for k in range(160)]
    for part, least in enumerate([36, 38, 40, 40]):
        assert sum(found[part::4]) >= least, shares[part]


def test_short_texts_equal_brute_force(documents):
    rng = random.Random(10)
    rows = []
    for k in range(60):
        text = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 9, 10, 20, 40, 50]))]
        rows.append(text)
        for _ in range(3):
            edited = list(text)
            for _ in range(rng.randrange(len(text) // 4 + 2)):
                at = rng.randrange(len(edited) + 1)
                edited[at:at + rng.randrange(2)] = rng.choice([[], ["x"], [rng.choice("abcdefgh")]])
            rows.append(edited or ["a"])
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            most = max(len(a), len(b))
            if label[i] != label[j] and 5 * abs(len(a) - len(b)) <= most and 5 * slow_distance(a, b) <= most:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    truth = {}
    for k, x in enumerate(label):
        truth.setdefault(x, set()).add(k)
    assert groups_of(nd.near_duplicates(documents([(k, " ".join(t)) for k, t in enumerate(rows)]))) == truth


def test_words_of_long_texts_are_not_stored_with_sketches():
    texts = ["a b c", " ".join(f"w{k}" for k in range(nd.SHORT + 1))]
    ids = pa.array([1, 2], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], names=["rid", "doc_id", "text"])
    (sketched,) = nd._sketch(iter([batch]))
    assert [tokens is None for tokens in sketched.column("tokens").to_pylist()] == [False, True]
    (lists,) = nd._token_lists(iter([batch.select(["text"])]))
    assert lists.column("identity") == sketched.column("key")
    assert [len(tokens) for tokens in lists.column("tokens").to_pylist()] == [4 * 3, 4 * (nd.SHORT + 1)]


def test_texts_apart_from_their_representative_are_compared_in_every_part(spark):
    rng, nodes, tokens, truth = random.Random(11), [], [], set()
    for k in range(12):  # in each bucket an unlike text comes first, then two that are alike
        unlike, text = ([rng.randrange(2**31) for _ in range(100)] for _ in range(2))
        other = [*text[:95], *(rng.randrange(2**31) for _ in range(5))]
        for at, words_of in enumerate((unlike, text, other)):
            nodes.append((3 * k + at, 100, [k]))
            tokens.append((3 * k + at, np.array(words_of, np.uint32).tobytes()))
        truth.add((3 * k + 1, 3 * k + 2))
    nodes = spark.createDataFrame(nodes, "node long, n int, bands array<long>")
    tokens = spark.createDataFrame(tokens, "key long, tokens binary")
    links = nd._links(nodes, tokens.limit(0), lambda keys: tokens.join(keys, "key", "left_semi"), nd.SIMILARITY)
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect()} == truth
