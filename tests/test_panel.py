"""Operators on small panels, against hand-made or brute-force results, and a leak test for as-of joins."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import metrics as M
from tidepanel.operators import asof as A
from tidepanel.operators import risk as R
from tidepanel.operators import windows as W
from tidepanel.operators import xsection as X

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def frames(spark, events):
    left = spark.createDataFrame([("a", day(n)) for n in range(6)] + [("b", day(2))], "k string, t date")
    return left, spark.createDataFrame([("a", day(n), v) for n, v in events], "k string, at date, v double")


@pytest.mark.parametrize("inclusive,expected", [(True, [None, 1.0, 1.0, 2.0, 2.0, 2.0]), (False, [None, None, 1.0, 1.0, 2.0, 2.0])])
def test_asof_backward(spark, inclusive, expected):
    left, right = frames(spark, [(1, 1.0), (3, 2.0)])
    got = A.asof(left, right, ["k"], "t", "at", ["v"], inclusive=inclusive).where("k = 'a'").orderBy("t").collect()
    assert [r.v for r in got] == expected


def test_asof_forward_and_tolerance(spark):
    left, right = frames(spark, [(3, 2.0)])
    got = A.asof(left, right, ["k"], "t", "at", ["v"], direction="forward", tolerance_days=1).where("k = 'a'").orderBy("t").collect()
    assert [r.v for r in got] == [None, None, 2.0, 2.0, None, None]


def test_asof_sees_no_future(spark):
    left, right = frames(spark, [(1, 1.0)])
    _, more = frames(spark, [(1, 1.0), (9, 5.0)])
    a, b = (sorted(map(tuple, A.asof(left, r, ["k"], "t", "at", ["v"]).collect()), key=str) for r in (right, more))
    assert a == b


def test_latest_covers_every_key(spark):
    import duckdb

    import __spark_entry__ as entry

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    for name in ("jn_09", "jn_09_all"):
        frame = entry.queries()[name](spark, where)
        got = sorted((int(r.ticker), str(r.period)[:10], int(r.company), str(r.date)[:10]) for r in frame.collect())
        expected = sorted((int(t), str(p)[:10], int(c), str(x)[:10]) for t, p, c, x in con.execute(entry.oracle_sql()[name]).fetchall())
        assert got == expected and got


def test_ewm_is_pandas(spark):
    x = [1.0, None, 3.0, 2.5, None, 7.0, 1.0]
    got = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "ticker string, di int, v double").select("di", W.ewm("v", span=3).alias("e")).orderBy("di").collect()
    expected = pd.Series(x).ewm(span=3).mean()
    assert [r.e for r in got] == pytest.approx(list(expected))


def test_average_rank_is_pandas(spark):
    x = [3.0, 1.0, None, 3.0, 2.0]
    got = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "di int, i int, v double").select("i", X.average_rank("v").alias("r")).orderBy("i").toPandas().r
    pd.testing.assert_series_equal(got.astype(float), pd.Series(x).rank(), check_names=False)


def test_hysteresis_keeps_state(spark):
    x = [0.5, 0.85, 0.7, None, 0.7, 0.9, 0.66, 0.6]
    got = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "ticker string, di int, v double").select("di", W.hysteresis("v", 0.2, 0.35).alias("h")).orderBy("di").collect()
    assert [r.h for r in got] == [False, True, True, False, False, True, True, False]


def test_metrics(spark):
    r = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.1, 0.0, -0.05])], "stream_id string, di int, r double")
    m = M.metrics(r, least=2).first()
    assert m.cr == pytest.approx(1.1 * 0.95 - 1) and m.mdd == pytest.approx(0.05) and m.hr == pytest.approx(1 / 3)


def test_controller_is_the_plain_loop(spark):
    import numpy as np

    r = np.random.default_rng(1).normal(0, 0.01, 120)
    got = R.controlled(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(r)], "stream_id string, di int, r double"), spark.createDataFrame([(0.005, 0.05)], "alpha double, gamma double")).orderBy("di").toPandas()
    loss, beta = -r, 0.85
    lo, hi = np.quantile(loss[:60], [0.01, 0.99])
    scale, c, x, q, out = max(hi - lo, 1e-6), 0.0, 1.0, 0.0, []
    for y in loss:
        big = x * y
        out.append(x)
        pen = c + max(big - c, 0) / (1 - beta)
        g = 1 - (big > c) / (1 - beta)
        q += g * g
        c = min(max(c - scale * g / (2 * np.sqrt(q)), lo), hi)
        x = min(max(x - 0.05 * (pen - 0.005) / scale, 0), 1)
    assert got.exposure.to_numpy() == pytest.approx(np.array(out))


def test_residuals_are_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 3))
    got = X.residual_ols(spark.createDataFrame([(1, i, *map(float, v)) for i, v in enumerate(x)], "di int, i int, y double, a double, b double"), "y", "a", "b", 20).orderBy("i").toPandas().residual
    a = np.column_stack([np.ones(30), x[:, 1:]])
    assert got.to_numpy() == pytest.approx(x[:, 0] - a @ np.linalg.lstsq(a, x[:, 0], rcond=None)[0])


def test_entry_imports_and_names_match():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).agg(F.count("*")).first()[0] > 0


def test_smoothed_ranks_keep_ties(spark):
    import math
    import random

    from tidepanel.plans.product_queries import smoothed

    draw, names, days = random.Random(3), 25, 6
    rows = [(t, d, float(v)) for d in range(days) for t, v in enumerate(draw.sample(range(names), names))]
    rank = {(t, d): (v + 1) / names for t, d, v in rows}
    for span in (3, 5, 10):
        got = {(r.ticker, r.di): r.value for r in smoothed(spark.createDataFrame(rows, "ticker int, di int, value double"), span).collect()}
        keep = 1 - 2 / (span + 1)
        weights = lambda d: [keep ** (d - k) for k in range(d + 1)]
        assert got == {(t, d): math.fsum(w * rank[t, k] for k, w in enumerate(weights(d))) / math.fsum(weights(d)) for t, d in rank}


def test_legs_at_neighbours_one_bit_apart(spark):
    import math
    import random

    import duckdb

    draw, rows = random.Random(8), []
    for d in range(160):
        v = sorted(draw.random() for _ in range((25, 24, 23, 12, 7, 2, 1, 21)[d % 8]))
        for q in (0.8, 0.2):  # the two values that a border lies between, equal but for rounding
            at = math.floor((len(v) - 1) * q)
            if at + 1 < len(v) and d < 140:
                v[at + 1] = v[at]
                for _ in range(d % 3):
                    v[at + 1] = math.nextafter(v[at + 1], 1)
        rows += [(d, t, x) for t, x in enumerate(v)]
    s = pd.DataFrame([*rows, (200, 0, 1.0), (200, 1, math.inf), (201, 0, -1.0), (201, 1, 2.0), (201, 2, 2.0)], columns=["di", "ticker", "value"])
    got = {(r.di, r.ticker): (r.up, r.down) for r in X.legs(spark.createDataFrame(s)).collect()}
    sql = "SELECT di, ticker, value >= quantile_cont(value, 0.8) OVER v, value <= quantile_cont(value, 0.2) OVER v FROM s WINDOW v AS (PARTITION BY di)"
    assert got == {(d, t): (up, down) for d, t, up, down in duckdb.sql(sql).fetchall()}


def test_legs_leave_out_nulls(spark):
    s = spark.createDataFrame([(1, t, v) for t, v in enumerate([3.0, None, 1.0, 2.0, None])] + [(2, 0, None)], "di int, ticker int, value double")
    got = sorted(map(tuple, X.legs(s).select("di", "ticker", "up", "down").collect()), key=str)
    assert got == [(1, 0, True, False), (1, 1, None, None), (1, 2, False, True), (1, 3, False, False), (1, 4, None, None), (2, 0, None, None)]
