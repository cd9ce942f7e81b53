"""Every graph query of the registry against its SQL."""

import glob
import os

import duckdb
import pytest

from wayfare import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(table, names):
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(repr([number(v) for v in r]) for r in zip(*[table[n].to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toArrow()
    if name not in catalog.oracle_sql():
        assert got.num_rows
        return
    want = duck.sql(catalog.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got, sorted(want.column_names)) == rows(want, sorted(want.column_names))
