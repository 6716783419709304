"""Every catalog query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tablelens import catalog_queries, workbench_queries  # noqa: F401  the second adds its queries to the first

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the supplied tables are not here")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, bool) or v is None else str(v)


@pytest.mark.parametrize("name", list(catalog_queries.queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in catalog_queries.NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog_queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(catalog_queries.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
