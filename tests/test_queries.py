"""Each registered ledger query against its SQL, on the smallest tables."""

import duckdb
import pytest

from meterlake.plans import coach_queries, log_queries, more_queries, queries

QUERIES = queries.QUERIES | coach_queries.QUERIES | more_queries.QUERIES | log_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | coach_queries.ORACLE_SQL | more_queries.ORACLE_SQL | log_queries.ORACLE_SQL
DATA = "/root/testdata/sf0.001"
TABLES = ["events", "documents", "conversations", "lineitem", "part", "supplier", "benchmark"]


def cell(v):
    return f"{v:.5e}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_the_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(map(cell, r)) for r in cur.fetchall())
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(map(cell, r)) for r in df.select(*names).collect()) == want
