"""The queries that SQL can express, against their SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tablelens.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    places = [want.columns.index(c) for c in cols]
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in places) for r in want.fetchall())
