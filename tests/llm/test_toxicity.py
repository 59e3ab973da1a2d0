import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wardlake.llm import toxicity as tx
from wardlake.llm.text import words


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    syllables = "an the er on re sti ou ble nd ha it ed".split()
    insults = ["moronic", "worthless", "idiot", "scumbag"]
    rows = []
    for doc_id in range(900):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < 0.3
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(insults)
        rows.append((doc_id, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark, labelled):
    from wardlake.llm.ship import ship_package
    ship_package(spark)
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in labelled], "doc_id long, quality int, toxic int")
    return {r.doc_id: r for r in tx.scores(docs, labels).collect()}


def test_held_out_accuracy(labelled, scored):
    held = [(i, toxic) for i, _, toxic in labelled if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 100
    assert all(scored[i].held_out for i, _ in held) and sum(r.held_out for r in scored.values()) == len(held)
    assert sum(scored[i].predicted == toxic for i, toxic in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored.values())


def test_held_out_labels_do_not_matter(spark, labelled, scored):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in labelled]
    labels = spark.createDataFrame(turned, "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in tx.scores(docs, labels).collect()}
    assert again == {i: r.score for i, r in scored.items()}


def test_margins_are_saved_bytes(labelled):
    model = tx.train([r[1] for r in labelled], [r[2] for r in labelled])
    found = tx._windows(words(pa.array(["worthless", "therestion", "sti nd worthless on the"])), 8)
    for margins in model.margins(found):
        assert margins[0] > 0 >= margins[1] and margins[2] > 0
    compressors = [tx._compressor(part + model.ordinary) for part in (b"", *model.toxic)]
    raw, anchor = found.data.tobytes(), model.ordinary[-24:]
    for at, (start, end) in enumerate(zip(found.starts, found.ends)):
        sizes = [len(each.compress(raw[start:end] + anchor)) for each in compressors]
        for row, size in enumerate(sizes[1:]):
            # Without a shared run of bytes the margin is nothing by definition.
            assert model.margins(found)[row, at] in (sizes[0] - size, 0)
    texts = [labelled[0][1], "", None, "worthless " * 100_000]
    alone = [model.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert model.scores(pa.array(texts, pa.string())).tolist() == pytest.approx(alone)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bc", "é", "x1", "long"]), max_size=30), max_size=5), st.integers(1, 5).map(lambda n: 2 * n))
def test_windows_cover_all_words(texts, width):
    found = tx._windows(words(pa.array([" ".join(own) for own in texts], pa.string())), width)
    raw, first = found.data.tobytes(), 0
    for own, end in zip(texts, found.text_ends.tolist()):
        windows = [raw[found.starts[at]:found.ends[at]].decode() for at in range(first, end)]
        expected = []
        for begin in range(0, max(1, len(own) - width // 2), width // 2) if own else ():
            expected.append(f" {' '.join(own[begin:begin + width])} ")
        assert windows == expected
        first = end


def made(kind, share, seed=1, n=2000):
    """Texts of made-up words; toxic ones hold rare insults, or one phrase of ordinary words."""
    rng = random.Random(seed)
    syllables = "an the er on re sti ou ble nd ha it ed ing for and wh st ly".split()
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(1500)]
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz") + rng.choice("aeiou") for _ in range(rng.randrange(3, 5))) for _ in range(400)]
    phrase = [vocabulary[at] for at in (3, 77, 500, 801, 20)]
    rows = []
    for _ in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        toxic = rng.random() < share
        if toxic and kind == "rare":
            for _ in range(4):
                own[rng.randrange(len(own))] = rng.choice(rare)
        if toxic and kind == "phrase":
            at = rng.randrange(len(own))
            own[at:at] = phrase
        rows.append((" ".join(own), int(toxic)))
    return rows[:n * 4 // 5], rows[n * 4 // 5:]


@pytest.mark.parametrize("kind,share", [("rare", 0.3), ("phrase", 0.3)])
def test_rare_words_and_phrases_of_ordinary_words(kind, share):
    train, held = made(kind, share)
    model = tx.train([text for text, _ in train], [toxic for _, toxic in train])
    found = model.scores(pa.array([text for text, _ in held])) >= 0.5
    toxic = np.array([toxic for _, toxic in held]) == 1
    assert found[toxic].mean() >= 0.9 and found[~toxic].mean() <= 0.02


def test_near_copies_are_one_witness():
    rng = random.Random(3)
    base = [" ".join(rng.choice(["one", "two", "three", "four", "five"]) + str(rng.randrange(90)) for _ in range(60)) for _ in range(3)]
    texts = [text.replace(str(n), "x", 1) for text in base for n in range(10)]
    spelled = [f" {text} ".encode() for text in texts]
    groups = tx._groups(spelled, np.ones(len(texts), np.int64))
    assert [len(set(groups[at:at + 10])) for at in (0, 10, 20)] == [1, 1, 1] and len(set(groups)) == 3
    # Copies with another label are witnesses of their own.
    assert len(set(tx._groups(spelled[:10], np.arange(10) % 2))) == 2


def test_nulls_empty_tables_and_missing_classes(spark, documents):
    docs = documents([(1, None, 0.1), (None, "", 0.2), (2, "some words", 0.3), (2, "some words", 0.3)], ", score double")
    for rows in ([], [(2, 0)], [(2, 1), (None, 1), (77, 1), (3, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        found = tx.scores(docs, labels).collect()
        assert len(found) == 4 and all(r.score < 1e-9 and r.predicted == 0 for r in found)
    assert tx.scores(documents([]), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).count() == 0
    kept = tx.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == 4
