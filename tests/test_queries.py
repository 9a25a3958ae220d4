"""Registered queries against their SQL in DuckDB."""

import duckdb
import pytest

from tidewater.plans import queries

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, duck):
    got = queries.QUERIES[name](spark, SF)
    rows = got.toPandas()
    assert len(rows)
    if name in queries.ORACLE_SQL:
        want = duck.execute(queries.ORACLE_SQL[name]).df()
        columns = sorted(rows.columns)
        assert columns == sorted(want.columns)
        rows, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (rows, want))
        assert len(rows) == len(want)
        for c in columns:
            assert ((rows[c] == want[c]) | (rows[c].isna() & want[c].isna())).all(), c
