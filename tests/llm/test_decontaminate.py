import hashlib
import random

import pytest

from wardlake.llm import decontaminate as dc

from .test_text import plain_words


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for item_id, item in items:
            v = plain_words(item)
            size = min(len(v), window)
            phrases = {tuple(v[i:i + size]) for i in range(len(v) - size + 1)} if size else set()
            for i in range(len(w) - size + 1) if size else ():
                if tuple(w[i:i + size]) in phrases:
                    hit.update(range(i, i + size))
                    if item_id is not None:
                        found.add(item_id)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_random_texts_against_brute_force(spark, documents):
    rng = random.Random(3)

    def text(n):
        return " ".join(rng.choice(["a", "B", "é", "d", "x1"]) for _ in range(n))

    items = [(k, text(rng.choice([1, 2, 3, 5, 6]))) for k in range(12)] + [(None, "a a"), (50, None), (51, "?!"), (3, "d d d")]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)] + [(None, "a a a"), (7, "x1 x1"), (8, None), (9, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, chunk in ((3, 200_000), (5, 4)):  # one chunk, and many
        index = dc.build_index(documents(docs), block_bytes=300)
        found = dc.find_phrases(index, bench, window, chunk_words=chunk)
        mine = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in found.collect()), key=repr)
        theirs = [(d, n, h) for d, n, h, *_ in brute(docs, items, window)]
        assert [m[:3] for m in mine] == theirs
    report = dc.contamination_report(documents(docs), bench, 3)
    assert sorted((tuple(r) for r in report.collect()), key=repr) == brute(docs, items, 3)


def test_no_phrase_reaches_over_a_text_boundary(spark, documents):
    docs = documents([(1, "one two"), (2, "three four")])
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert {r.n_hit for r in dc.contamination_report(docs, items).collect()} == {0}


def test_empty_tables_and_extra_columns(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c", 5)], ", block int")
    assert [tuple(r)[:4] for r in dc.contamination_report(docs, none).collect()] == [(1, 3, 0, 0)]
    assert dc.contamination_report(documents([]), none).count() == 0


def test_contaminated_rows_go_and_others_keep_all_columns(spark, documents):
    phrase = " ".join(f"w{k}" for k in range(12))
    docs = documents([(1, f"so {phrase} it", "x"), (1, "clean", "y"), (2, None, "z")], ", source string")
    items = spark.createDataFrame([(9, phrase)], "item_id long, text string")
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.source for r in kept.collect()) == ["y", "z"]


def test_very_long_text(spark, documents):
    phrase = " ".join(f"w{k}" for k in range(10))
    text = "filler " * 300_000 + phrase + " tail" * 1000
    row = dc.contamination_report(documents([(1, text)]), spark.createDataFrame([(1, phrase)], "item_id long, text string")).first()
    assert (row.n_words, row.n_hit) == (301_010, 10)


@pytest.mark.parametrize("within", [2, 3, 5])
def test_proximity_against_brute_force(spark, documents, within):
    rng = random.Random(within)
    docs = [(k, " ".join(rng.choice("abcdef") for _ in range(30))) for k in range(6)]
    items = [(1, "a b"), (2, "c a"), (3, "a b c"), (4, "f"), (5, "a zz")]
    expected = set()
    for doc_id, text in docs:
        w = text.split()
        for item_id, item in items:
            terms = set(item.split())
            ranges = {(b, e) for b in range(len(w)) for e in range(b + 1, min(len(w), b + within) + 1) if terms <= set(w[b:e])}
            expected |= {(doc_id, item_id, b, e) for b, e in ranges if (b + 1, e) not in ranges and (b, e - 1) not in ranges}
    index = dc.build_index(documents(docs))
    found = dc.find_near(index, spark.createDataFrame(items, "item_id long, text string"), within)
    assert {tuple(r) for r in found.collect()} == expected


def test_item_ids_of_text_and_columns_with_dots(spark, documents):
    phrase = " ".join(f"w{k}" for k in range(12))
    docs = documents([(1, f"so {phrase} it", "x"), (2, "clean", "y")], ", `a.b` string")
    items = spark.createDataFrame([("q/10", phrase), ("q/9", phrase), (None, phrase)], "item_id string, text string")
    kept = dc.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and [r["a.b"] for r in kept.collect()] == ["y"]
    found = {r.doc_id: r for r in dc.contamination_report(docs, items).collect()}
    digest = hashlib.sha256(b"q/10,q/9").hexdigest()
    assert (found[1].n_items, found[1].items_sha256, found[2].n_items) == (2, digest, 0)
    near = dc.find_near(dc.build_index(docs), items, 20).collect()
    assert {r.item_id for r in near} == {"q/10", "q/9", None}


def test_chunks_are_bounded_by_short_items_too(spark):
    items = spark.createDataFrame([(k, "a") for k in range(50)], "item_id long, text string")
    assert len(list(dc.item_chunks(items, "item_id", "text", 10))) == 5
