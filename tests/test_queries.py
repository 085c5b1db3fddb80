"""Every query of the lists against its SQL in DuckDB, on the test tables."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

from cladeflow import queries as lists

DATA = Path("/root/testdata/sf0.001")
SQL = lists.oracle_sql()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def plain(x):
    """A value in one form for both engines."""
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, bool) or x is None:
        return x
    if hasattr(x, "as_tuple") or isinstance(x, float):
        return "nan" if math.isnan(float(x)) else float(f"{float(x):.9g}")
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, found) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(lists.queries()))
def test_query_equals_sql(spark, duck, name):
    made = lists.queries()[name](spark, str(DATA))
    got = rows(made.columns, made.collect())
    if name not in SQL:
        return
    other = duck.execute(SQL[name])
    names = [c[0] for c in other.description]
    assert sorted(names) == sorted(made.columns)
    assert got == rows(names, other.fetchall())
