import zlib
from collections import Counter

import numpy as np
import pytest

from wardlake.llm import sharding as sh


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation_and_its_inverse(n):
    permutation = sh.Feistel(n)
    places = permutation.place(np.arange(n))
    assert sorted(places.tolist()) == list(range(n))
    assert (permutation.number(places) == np.arange(n)).all()
    if n > 100:
        assert (sh.Feistel(n, seed=1).place(np.arange(n)) != places).mean() > 0.9
        assert abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.15


def test_law_slots_and_reruns(spark, documents):
    docs = [(k * 7 % 1000, f"text {k}" if k % 9 else None) for k in range(1001)] + [(3, "same")] * 300
    df = documents(docs)
    rows = sh.assign(df).collect()
    assert len(rows) == len(docs)
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    again = sh.assign(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, rows))
    for r in rows[:20]:
        assert sh.row_number_at(r.shard, r.slot, len(rows)) == r.number


def test_nulls_empty_tables_and_clashing_columns(spark, documents):
    docs = documents([(None, None, 1), (1, "é", 2), (1, "é", 2), (2, "x" * 1_000_000, 3)], ", number int")
    rows = {r.doc_id: r for r in sh.assign(docs).collect()}
    assert (rows[None].size, rows[None].text_crc32) == (1, 0) and rows[1].size == 3
    assert rows[1].law == "rows" and rows[1].grown_shard is None
    whole = sh.sharded(docs)
    assert whole.columns == [*docs.columns, "shard", "slot"] and whole.count() == 4
    assert sh.assign(documents([])).count() == 0


def test_columns_named_like_the_result_give_way(documents):
    docs = documents([(k, "t", 7, 8, k) for k in range(20)], ", Shard int, slot int, `a.b` int")
    whole = sh.sharded(docs)
    assert whole.columns == ["doc_id", "text", "a.b", "shard", "slot"]
    rows = whole.collect()
    assert {(r.shard, r.slot) for r in rows} == {(k % 8, k // 8) for k in range(20)}
    assert all(r["a.b"] == r.doc_id for r in rows)


def test_rows_equal_in_id_and_text_keep_their_places(documents):
    docs = documents([(1, "same", k % 5) for k in range(30)], ", other int")
    one = sorted(map(tuple, sh.sharded(docs).collect()))
    assert sorted(map(tuple, sh.sharded(docs.repartition(4).orderBy("other")).collect())) == one
