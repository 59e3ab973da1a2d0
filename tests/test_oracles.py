"""Every registered query against its SQL on DuckDB, rows and types."""

import glob
import os
import re

import duckdb
import pytest

import __spark_entry__ as registry

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

# DuckDB's name of each Spark type that is spelled differently.
TYPES = {"int": "INTEGER", "string": "VARCHAR"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _own(names):
    """Queries of the library itself; those of the subpackage have tests of their own."""
    return [n for n in names if n != "pipeline" and not re.match(r"op\d+_", n)]


def test_every_query_has_an_oracle():
    assert _own(registry.queries()) and set(_own(registry.queries())) == set(_own(registry.oracle_sql()))


@pytest.mark.parametrize("name", _own(registry.queries()))
def test_same_rows_and_types(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    mine = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)

    result = duck.execute(registry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    kinds = {column[0]: str(column[1]) for column in result.description}
    assert sorted(names) == columns
    theirs = sorted(
        (tuple(row[names.index(c)] for c in columns) for row in result.fetchall()), key=repr
    )
    assert len(mine) == len(theirs)
    assert mine == theirs
    assert {c: TYPES.get(t, t.upper()) for c, t in df.dtypes} == kinds


def test_entry(spark):
    df = registry.entry(spark)
    assert 0 < df.count() <= 50
    assert df.columns[:3] == ["ccn", "provider_name", "state"]
