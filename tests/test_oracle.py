"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from antiphon.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value):
    if isinstance(value, float):
        return repr(round(value, 7) + 0.0)
    return "[" + ",".join(map(plain, value)) + "]" if isinstance(value, (list, tuple)) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in ORACLE:
        return
    want = db.sql(ORACLE[name])
    assert columns == sorted(want.columns)
    assert rows == sorted(tuple(map(plain, r)) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())
