"""Every query of the engine's own operators against its SQL."""

import glob
import os

import duckdb
import pytest

from seamline.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, DATA).toArrow()
    if name not in SQL:
        assert got.num_rows > 0
        return
    con.register("got", got)
    con.sql(f"create or replace temp table want as {SQL[name]}")
    columns = ", ".join(f'"{r[0]}"' for r in con.sql("describe want").fetchall())
    assert sorted(got.column_names) == sorted(r[0] for r in con.sql("describe want").fetchall())
    missing = con.sql(f"select {columns} from want except all select {columns} from got").fetchall()
    extra = con.sql(f"select {columns} from got except all select {columns} from want").fetchall()
    assert (missing[:2], extra[:2]) == ([], [])
