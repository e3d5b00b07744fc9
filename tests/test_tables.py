"""Each query over the plain tables gives the rows of its SQL in DuckDB."""

from collections import Counter

import duckdb
import pytest

from tidepanel.plans import table_queries as T

WHERE = "/root/testdata/sf0.001"
TABLES = "nation customer supplier part orders lineitem events documents labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{WHERE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(T.QUERIES))
def test_equals_sql(spark, duck, name):
    found = T.QUERIES[name](spark, WHERE)
    expected = duck.sql(T.ORACLE[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = found.select(*expected.columns).collect()
    assert Counter(map(tuple, rows)) == Counter(expected.fetchall())
