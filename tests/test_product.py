"""Each query over the panel, decisions and texts gives the rows of its SQL in DuckDB."""

import datetime as dt
import decimal
import math
from collections import Counter

import duckdb
import pytest

from tidepanel.plans import context_queries, corpus_queries, model_queries, panel_queries, product_queries, stream_queries  # noqa: F401 (adds to panel_queries)

WHERE = "/root/testdata/sf0.001"
#: With ten names these have no whole leg, or values at the edge of rounding; they are compared on the next larger tables.
LARGER = ("met_01", "win_12", "jn_03", "jn_04", "jn_05", "ic_02", "sig_13", "sig_15", "sig_12")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()
QUERIES = panel_queries.QUERIES | corpus_queries.QUERIES | stream_queries.QUERIES | model_queries.QUERIES | context_queries.QUERIES
ORACLE = panel_queries.ORACLE | corpus_queries.ORACLE | stream_queries.ORACLE | model_queries.ORACLE | context_queries.ORACLE


@pytest.fixture(scope="module")
def duck():
    def views(where):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
        return con

    return {where: views(where) for where in (WHERE, WHERE.replace("0.001", "0.01"))}


def plain(x):
    if isinstance(x, float | decimal.Decimal):
        return None if math.isnan(x) else round(float(x), 4) + 0.0
    if isinstance(x, dt.datetime):
        return x.date() if x.time() == dt.time() else x
    return x


@pytest.mark.parametrize("name", list(ORACLE))
def test_equals_sql(spark, duck, name):
    where = WHERE.replace("0.001", "0.01") if name in LARGER else WHERE
    found = QUERIES[name](spark, where)
    expected = duck[where].sql(ORACLE[name])
    assert sorted(found.columns) == sorted(expected.columns)
    rows = found.select(*expected.columns).collect()
    assert Counter(tuple(map(plain, r)) for r in rows) == Counter(tuple(map(plain, r)) for r in expected.fetchall())


def test_keyed_json_and_feeds(spark, tmp_path):
    from tidepanel.sources import files

    (tmp_path / "AAA.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "BBB.json").write_text("[]")
    assert sorted(map(tuple, files.keyed_json(spark, str(tmp_path), "x int").collect())) == [(1, "AAA"), (2, "AAA")]
    feed = "<rss><item><title><![CDATA[A & B]]></title><link>u</link><source url='s'>S</source><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>no time</title></item></rss>"
    got = files.feed_items(spark.createDataFrame([(1, feed)], "id int, text string"), "text").collect()
    assert [(r.id, r.headline, r.source, r.url, str(r.published)) for r in got] == [(1, "A & B", "S", "u", "2024-01-01 10:00:00")]
