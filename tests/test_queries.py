"""Every registered query against its DuckDB SQL on the smallest data set."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from ventanilla.plans.file_queries import FILE_QUERIES
from ventanilla.plans.oracle import queries_sql
from ventanilla.plans.queries import QUERIES
from ventanilla.plans.store_queries import STORE_QUERIES
from ventanilla.sources.tables import TABLES

from conftest import SF_SMALL

SQL = queries_sql()
NAMES = sorted(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


def _key(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v.isoformat() if hasattr(v, "isoformat") else v
    return sorted(tuple(repr(norm(r[i])) for i in order) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) | set(FILE_QUERIES) | set(STORE_QUERIES) == set(SQL)
    assert set(SQL) <= set(E.queries()) and set(SQL) <= set(E.oracle_sql())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    res = con.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _key(df.columns, [tuple(r) for r in df.collect()]) == _key(dcols, res.fetchall())
