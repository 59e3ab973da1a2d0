import random
from collections import Counter

import pytest

from wardlake.llm import mixing

DOCS = "doc_id long, source string, text string"


def water_fill(sizes, weights=mixing.WEIGHTS, cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return target | {s: left * weight[s] / total for s in open_}
        for s in above:
            target[s] = float(cap * sizes[s])
            left -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 10, "c": 1000, None: 5}, {"a": 0, "b": 3},
    {f"s{k}": (k * 37) % 91 for k in range(30)}, {"é": 5, "z": 50, "Z": 500, "": 1},
])
def test_targets_share_all_words_up_to_the_cap(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.targets(table).collect()}
    expected = water_fill(sizes)
    assert found.keys() == expected.keys()
    assert all(found[s] == pytest.approx(expected[s]) for s in sizes)
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


def test_taken_words_come_near_the_targets(spark):
    rng = random.Random(1)
    docs = [(k, "big" if k % 3 else rng.choice(["a", "b", None]), "w " * rng.randrange(0, 40)) for k in range(1500)]
    df = spark.createDataFrame(docs, DOCS)
    rows = mixing.mix(df).collect()
    assert len(rows) == 1500
    sizes = {(k, s): len(t.split()) for k, s, t in docs}
    by_id = {k: (s, len(t.split())) for k, s, t in docs}
    taken = {}
    for r in rows:
        source, size = by_id[r.doc_id]
        assert r.size == size and r.taken in {k * size for k in range(4)}
        taken.setdefault(source, [r.target, 0])[1] += r.taken
    assert sum(sizes.values()) > 0
    for target, words in taken.values():
        assert abs(target - words) <= 40  # one document
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_smaller_budgets_choose_subsets(spark):
    items = spark.range(500).selectExpr("'s' AS source", "id % 7 + 1 AS size", "xxhash64(id) AS hash")
    chosen = []
    for budget in (0.0, 300.0, 1200.0):
        edge = mixing.thresholds(items, spark.createDataFrame([("s", budget)], "source string, budget double"))
        prefix = edge.first().prefix
        picked = {r.hash for r in items.collect() if (r.hash % 2**64) >> (64 - mixing.BITS * mixing.LEVELS) < prefix}
        size = sum(r.size for r in items.collect() if r.hash in picked)
        assert abs(size - budget) <= 4
        chosen.append(picked)
    assert chosen[0] <= chosen[1] <= chosen[2]


def test_nulls_empty_texts_repeats_and_extra_columns(spark):
    rows = [(None, None, None, 1), (1, "a", "", 2), (1, "a", "x y", 3), (1, "a", "x y", 3), (2, "b", " \t\n\x0b", 4)]
    df = spark.createDataFrame(rows, DOCS + ", hash int")
    found = mixing.mix(df).collect()
    assert len(found) == 5 and all(r.taken <= 3 * r.size for r in found)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r.times for r in found) and all(r.taken == r.times * r.size for r in found)
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mixed_rows(spark.createDataFrame([], DOCS)).count() == 0


def test_documents_without_words_are_mixed_like_others(spark):
    rows = [(k, "a", "w " * 30) for k in range(40)] + [(100 + k, "a", None if k % 2 else " ") for k in range(40)]
    rows += [(200 + k, "b", "w " * 3) for k in range(40)]
    df = spark.createDataFrame(rows, DOCS)
    counts = Counter(r.doc_id for r in mixing.mixed_rows(df).collect())
    plan = {r.doc_id: r.times for r in mixing.mix(df).collect()}
    assert all(counts[i] == n for i, n in plan.items())
    # Source b is taken three times over, source a about nine tenths of it, with or without words.
    assert all(plan[200 + k] == 3 for k in range(40))
    assert 25 <= sum(plan[100 + k] for k in range(40)) <= 40


def test_spaces_are_those_of_the_contract(spark):
    df = spark.createDataFrame([(1, "a", "x y z\x1cw v\r\nq")], DOCS)
    assert mixing.mix(df).first().size == 3  # blanks and control spaces part words, others do not


def test_main_path_has_no_python(spark):
    plan = mixing.mix(spark.createDataFrame([(1, "a", "x")], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "EvalPython" not in plan
