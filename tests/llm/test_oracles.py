import os

import duckdb
import pytest

from taxolyte.llm.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    df = QUERIES[name](spark, DATA)
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(tuple(r[want.columns.index(n)] for n in names) for r in want.fetchall())
