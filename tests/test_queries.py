"""Every registered engine query against its SQL in DuckDB, over whole tables."""

import math
from pathlib import Path

import duckdb
import pytest

from loomsearch import queries

DATA = "/root/testdata/sf0.001"
NAMES = sorted(queries.queries())

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6) + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
