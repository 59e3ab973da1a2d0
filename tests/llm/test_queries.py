"""Registered queries against their SQL where there is one."""

import duckdb
import pytest

from wardlake.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = duck.execute(ORACLE_SQL[name])
    names = sorted(c[0] for c in result.description)
    places = [[c[0] for c in result.description].index(n) for n in names]
    theirs = sorted((tuple(row[p] for p in places) for row in result.fetchall()), key=repr)
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == names
    assert sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr) == theirs


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
