"""Every query with SQL against DuckDB on the smallest tables: rows, names and types."""

import glob
import os

import duckdb
import pytest

from tallymark.registry import ORACLES, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(sf + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(found):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df, want = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    types = dict(zip(want.columns, map(str, want.types)))
    assert {k: KINDS.get(v) for k, v in df.dtypes} == types
    assert rows(tuple(r) for r in df.select(*cols).collect()) == rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
