"""The queries of the package that have SQL, against it in DuckDB, over whole tables."""

import glob
import os

import duckdb
import pytest

from foliant.llm import queries

SF = "/root/testdata/sf0.001"
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(SQL[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    ordered = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert ordered(got.select(*names).collect()) == ordered(want.fetchall())
