"""The queries of the training-data operators against their SQL."""

import os

import duckdb
import pytest

from masswright.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    want = con.sql(queries.ORACLES[name])
    assert sorted(want.columns) == columns
    got, want = (sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr) for rows in (found.select(*columns).collect(), want.select(*columns).fetchall()))
    assert got == want and (got or name == "op11_phrases")
