"""Operators on hand-made and random rows against plain versions; what must not show, late rows, restarts, broken parts."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import asof as A
from tidepanel.operators import band as B
from tidepanel.operators import context as C
from tidepanel.operators import order as O
from tidepanel.operators import pairs as PR
from tidepanel.operators import windows as W
from tidepanel.plans import context_queries, corpus_queries, model_queries, stream_queries
from tidepanel.sources import files
from tidepanel.streaming import jobs

WHERE = "/root/testdata/sf0.001"


def test_exponential_means_equal_pandas(spark):
    rng = np.random.default_rng(0)
    rows = [(k, i, None if rng.random() < (0.02, 0.3, 0.97)[k] else float(rng.normal() * 100)) for k in range(3) for i in range(900)]
    df = spark.createDataFrame(rows, "ticker int, di int, x double")
    out = W.with_ewm(df, "a", "x", span=3)  # blocks of 57 rows, of 196, and of 529
    out = W.with_ewm(W.with_ewm(W.with_ewm(out, "b", "x", span=10), "c", "x", alpha=1 / 14), "d", "x", alpha=1.0)
    got = out.orderBy("ticker", "di").toPandas()
    for _, g in got.groupby("ticker"):
        for name, how in (("a", {"span": 3}), ("b", {"span": 10}), ("c", {"alpha": 1 / 14}), ("d", {"alpha": 1.0})):
            assert np.allclose(g[name], g["x"].ewm(**how).mean(), rtol=1e-12, equal_nan=True)


def test_trailing_distinct_equals_sets(spark):
    rng = np.random.default_rng(1)
    events = [(int(rng.integers(3)), int(rng.integers(100)), int(rng.integers(9)) or None) for _ in range(400)]
    days = [(k, d, "kept") for k in range(4) for d in range(100) if rng.random() < 0.8]
    e, d = spark.createDataFrame(events, "ticker int, di int, firm int"), spark.createDataFrame(days, "ticker int, di int, note string")
    for n in (1, 7, 40):
        got = {(r.ticker, r.di): r.n for r in W.trailing_distinct(e, d, "firm", n, "n").collect()}
        assert got == {(k, day): len({f for t, at, f in events if t == k and f and day - n < at <= day}) for k, day, _ in days}


def test_places_ranks_and_running_sums(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)) if i % 3 else 0, float(rng.integers(40)), float(rng.normal())) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, key int, a double, b double").repartition(7)
    place = {r.id: r.pos for r in O.numbered(df, ["a", "id"]).collect()}
    assert [i for i, _ in sorted(place.items(), key=lambda x: x[1])] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))] and sorted(place.values()) == list(range(500))
    got = O.average_ranks(df, ["a", "b"]).toPandas()
    assert np.allclose(got["rank_a"], got["a"].rank()) and np.allclose(got["rank_b"], got["b"].rank())
    run = O.running(df, ["key"], ["id"], "a", "sum").orderBy("id").toPandas()
    assert np.allclose(run["sum"], run.groupby("key")["a"].cumsum())
    assert O.numbered(df.where("id < 0"), ["id"]).count() == 0


def test_capped_and_strided_choices(spark):
    rng = np.random.default_rng(3)
    rows = [("big" if rng.random() < 0.9 else "small", int(rng.integers(12)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "cls string, di int, ticker int")
    caps = spark.createDataFrame([("big", 71), ("small", 10_000)], "cls string, cap long")
    by = lambda c: sorted(r[1:] for r in rows if r[0] == c)
    got = sorted(map(tuple, O.first_of_each(df, caps, "cls", "di", "ticker").collect()))
    assert got == sorted([("big", *r) for r in by("big")[:71]] + [("small", *r) for r in by("small")])
    got = sorted(map(tuple, O.every_stride(df, 40, "cls", "di", "ticker").collect()))
    expected = [(c, *r) for c in ("big", "small") for k, r in enumerate(by(c)) if k % (s := max(len(by(c)) // 40, 1)) == 0 and k // s < 40]
    assert got == sorted(expected)


def test_nearest_in_band_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    common, sets = list("abcdefgh"), []
    for i in range(260):
        own = [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 30))]
        sets.append(sorted(set(own + common[: rng.integers(0, 9)])) if i % 11 else (sets[i - 7] if i % 2 and i > 7 else []))
    df = spark.createDataFrame(list(enumerate(sets)), "pos long, words array<string>")
    for width in (1, 20, 300):
        got = {r.pos: r.nearest for r in B.nearest_in_band(df, width, 50).collect()}
        for i, a in enumerate(map(set, sets)):
            others = [set(sets[j]) for j in range(max(0, i - width), min(len(sets), i + width + 1)) if j != i]
            assert got[i] == pytest.approx(max((len(a & b) / len(a | b) for b in others if a | b), default=0.0)), (width, i)
    assert B.nearest_in_band(df.where("pos < 0")).count() == 0 and B.nearest_in_band(df.where("pos = 1")).first().nearest == 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_spread_asof_equals_a_search(spark, direction, inclusive):
    rng = np.random.default_rng(8)
    key = lambda: None if rng.random() < 0.05 else ("hot" if rng.random() < 0.8 else "cold")
    start = dt.date(2024, 1, 1)
    left = [(i, key(), start + dt.timedelta(int(rng.integers(60)))) for i in range(300)]
    right = [(key(), start + dt.timedelta(int(rng.integers(60))), int(k)) for k in rng.permutation(90)]
    l, r = spark.createDataFrame(left, "id int, key string, day date"), spark.createDataFrame(right, "key string, at date, v int")
    got = {x.id: (x.matched, x.v) for x in A.asof(l, r, ["key"], "day", "at", ["v"], direction=direction, inclusive=inclusive, tie="v", spread=True).collect()}
    plain = {x.id: (x.matched, x.v) for x in A.asof(l, r, ["key"], "day", "at", ["v"], direction=direction, inclusive=inclusive, tie="v").collect()}
    assert got == plain and len(got) == 300
    for i, k, day in left:
        fits = [(at, v) for q, at, v in right if q == k and ((at < day or inclusive and at == day) if direction == "backward" else (at > day or inclusive and at == day))]
        best = (max if direction == "backward" else min)(fits, default=(None, None))
        assert got[i][0] == best[0] and (direction == "forward" or got[i][1] == best[1])


def test_pairs_of_large_keys_are_whole(spark):
    rows = [("hot", i) for i in range(60)] + [("small", i) for i in range(3)] + [("one", 1)]
    df = spark.createDataFrame(rows, "key string, id int")
    for size in (7, 1000):
        got = [tuple(r) for r in PR.pairs(df, ["key"], "id", rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) == {(k, i, j) for k, i in rows for q, j in rows if k == q and i < j}
    assert PR.mirrored(PR.pairs(df, ["key"], "id")).count() == 2 * (60 * 59 // 2 + 3)


def item(name, kind, ts, text, key="", tie=0):
    return (name, key, kind, dt.datetime.fromisoformat(ts), tie, text)


def test_context_shows_nothing_later_and_keeps_caps(spark):
    rows = [item("A", "news", "2024-01-31T00:00:00", "at the time itself", tie=1), item("A", "news", "2024-01-31T00:00:01", "LATER"), item("A", "news", "2023-12-31T23:59:59", "too old for buckets"), item("A", "news", "2024-01-01T00:00:00", "thirty days")]
    rows += [item("A", "news", f"2024-01-{30 - i // 10:02d}T{i % 10:02d}:00:00", f"recent {i}", tie=i) for i in range(25)]
    rows += [item("A", "fundamental", "2023-05-01T00:00:00", "old figure", "sales"), item("A", "fundamental", "2024-01-20T00:00:00", "new figure", "sales"), item("A", "fundamental", "2024-02-01T00:00:00", "LATER", "sales"), item("A", "fundamental", "2020-01-01T00:00:00", "assets", "assets")]
    rows += [item("A", "analyst", f"2024-01-{i + 1:02d}T00:00:00", f"grade {i:02d}", tie=i) for i in range(20)] + [item("A", "insider", "2024-02-02T00:00:00", "LATER"), item("A", "insider", "2023-10-01T00:00:00", "beyond ninety days")]
    rows += [item("*", "macro", "2024-01-02T00:00:00", "rate 1", "RATE"), item("*", "macro", "2024-01-30T00:00:00", "rate 2", "RATE"), item("*", "macro", "2024-03-01T00:00:00", "LATER", "RATE")]
    items = spark.createDataFrame(rows, "name string, key string, kind string, ts timestamp_ntz, tie long, item string")
    asked = spark.createDataFrame([("A", dt.datetime(2024, 1, 31)), ("B", dt.datetime(2024, 1, 31)), ("A", dt.datetime(2019, 1, 1))], "ticker string, as_of timestamp_ntz")
    got = {(r.ticker, r.as_of.year): r.context for r in C.sections(asked, items).collect()}
    text = got["A", 2024].split("\n")
    assert not any("LATER" in t for t in got.values())
    newest = text[2:12]
    assert text[:2] == ["=== NEWS (last 30d) ===", "  [≤3d]"] and newest[0] == "at the time itself" and newest[1] == "recent 9" and len([t for t in text if t.startswith("recent")]) == 9
    assert "thirty days" in text and "too old for buckets" not in text and "beyond ninety days" not in text
    assert text[text.index("=== FUNDAMENTALS (latest filed) ===") + 1 :][:2] == ["assets", "new figure"]
    assert [t for t in text if t.startswith("grade")] == [f"grade {i:02d}" for i in range(19, 7, -1)]
    assert text[-2:] == ["=== MACRO (latest) ===", "rate 2"]
    assert got["B", 2024].split("\n") == ["=== NEWS (last 30d) ===", "  none", "=== FUNDAMENTALS (latest filed) ===", "  none", "=== SENTIMENT ===", "  none", "=== MACRO (latest) ===", "rate 2"]
    assert got["A", 2019].count("  none") == 4
    rich = {(r.ticker, r.as_of.year): r.context for r in C.sections(asked, items, rich=True).collect()}["A", 2024]
    assert rich.count("recent") == 25 and "too old for buckets" in rich and "[≤3d]" not in rich


def test_rebalance_days_snap_back_and_start_inside(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (2, 3, 4, 8, 9, 11, 12, 17)], "date date")
    got = sorted(r.date.day for r in context_queries.rebalance_days(spark, days, "2024-01-03", "2024-01-31").collect())
    assert got == [4, 12, 17]  # Fridays 5, 12, 19 and 26; the last two give the same day
    early = sorted(r.date.day for r in context_queries.rebalance_days(spark, days, "2024-01-05", "2024-01-19").collect())
    assert early == [12, 17]  # the 4th lies before the start


def test_snapshots_without_bars_and_causal(spark):
    bars = spark.createDataFrame([(1, dt.date(2024, 1, d), [f"bar {d}"], ["  x: 1"]) for d in (2, 9)], "ticker int, date date, bars array<string>, found array<string>")
    asked = spark.createDataFrame([(1, dt.date(2024, 1, 1)), (1, dt.date(2024, 1, 8)), (2, dt.date(2024, 1, 8))], "ticker int, as_of date")
    got = {(r.ticker, r.as_of.day): r.snapshot for r in context_queries.snapshots(asked, bars).collect()}
    assert got[1, 1] == "Ticker 1 as of 2024-01-01: no data." and got[2, 8] == "Ticker 2 as of 2024-01-08: no data."
    assert "bar 2" in got[1, 8] and "bar 9" not in got[1, 8]


def test_eastern_time_equals_the_zone_tables(spark):
    said = [int(dt.datetime(2024, m, d, hh, 30, tzinfo=dt.UTC).timestamp()) for m, d, hh in ((1, 5, 3), (1, 5, 21), (3, 10, 6), (3, 10, 7), (7, 4, 19), (7, 4, 20), (11, 3, 5), (11, 3, 6), (12, 31, 23))]
    rows = spark.createDataFrame([(s,) for s in said], "s long").select("s", F.date_format(corpus_queries.eastern(F.col("s")), "yyyy-MM-dd HH:mm").alias("local")).collect()
    assert {r.s: r.local for r in rows} == {s: dt.datetime.fromtimestamp(s, ZoneInfo("America/New_York")).strftime("%Y-%m-%d %H:%M") for s in said}


def test_one_run_equals_restarts(spark, tmp_path):
    """The windows of all deliveries in one run of many batches are those of a run that stops after each."""
    e = stream_queries.delivered(stream_queries.stamped(spark, WHERE))
    stopped = stream_queries.in_deliveries(spark, e, lambda x: jobs.trailing_counts(x, "user_id"), "stops")
    for b in sorted(r[0] for r in e.select("batch").distinct().collect()):
        e.where(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
    one = jobs.trailing_counts(spark.readStream.schema(e.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/source"), "user_id")
    jobs.run_to_table(one, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    rows = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").collect()))
    assert rows == sorted(map(tuple, stopped.collect())) and rows
    assert sum(r[2] for r in rows) < e.count() * 3  # late rows are missing


def test_feeds(spark):
    xml = """<?xml version="1.0"?><rss xmlns:m="urn:m"><channel><title>top</title>
      <item><title>A &amp; B &lt;i&gt;</title><link>u1?a=1&amp;b=2</link><m:thing>x</m:thing><source url="s">S &#233;</source><pubDate>1 Jan 2024 10:00 EST</pubDate></item>
      <item><title><![CDATA[raw <b> & more]]></title><link>u2</link><pubDate>Tue, 02 Jan 2024 10:00:00 +0530</pubDate></item>
      <item><title>no time</title><pubDate>soon</pubDate></item><item><title>nor here</title></item></channel></rss>"""
    feeds = spark.createDataFrame([(1, xml), (2, xml[:300]), (3, None), (4, "<rss><channel></channel></rss>"), (5, "no xml at all")], "id int, text string")
    got = {(r.id, r.broken, r.headline, r.source, r.url, str(r.published)) for r in files.feed_items(feeds, "text").collect()}
    assert got == {(1, False, "A & B <i>", "S é", "u1?a=1&b=2", "2024-01-01 15:00:00"), (1, False, "raw <b> & more", None, "u2", "2024-01-02 04:30:00"), (2, True, None, None, None, "None"), (5, True, None, None, None, "None")}


def test_ingest_takes_a_broken_part_again(spark, tmp_path):
    where = str(tmp_path / "in")
    rows = spark.createDataFrame([(k, p, f"{k}-{p}") for p in range(4) for k in range(p, p + 3)], "k int, p int, v string")
    assert files.ingest_parts(rows.where("p < 2"), "p", where)
    before = sorted(f.name for f in (tmp_path / "in/parts/p=0").iterdir())
    files.write_parts(rows.where("p = 2 and k = 2").withColumn("v", F.lit("half")), "p", where)
    assert "half" not in {r.v for r in files.combined(spark, where, "p", ["k"]).collect()}
    assert files.ingest_parts(rows, "p", where) and not files.ingest_parts(rows, "p", where)
    assert sorted(f.name for f in (tmp_path / "in/parts/p=0").iterdir()) == before
    assert sorted((r.k, r.v) for r in files.combined(spark, where, "p", ["k"]).collect()) == [(0, "0-0"), (1, "1-1"), (2, "2-2"), (3, "3-3"), (4, "4-3"), (5, "5-3")]


def test_keyed_files(spark, tmp_path):
    rows = spark.createDataFrame([("A", json.dumps([{"x": 1}])), ("B", "[]")], "key string, value string")
    files.write_keyed(rows, str(tmp_path / "k"))
    assert [tuple(r) for r in files.keyed_json(spark, str(tmp_path / "k"), "x int").collect()] == [(1, "A")]


def stump(x, y, least=1):
    """The best single split of one feature by squared error: (threshold, left mean, right mean)."""
    order = np.argsort(x)
    x, y = x[order], y[order]
    best = min(((y[:k].var() * k + y[k:].var() * (len(y) - k), k) for k in range(least, len(y)) if x[k] != x[k - 1]))[1]
    return (x[best - 1] + x[best]) / 2, y[:best].mean(), y[best:].mean()


def test_trees_equal_a_plain_fit(spark):
    """Boosting with trees of one split on a few values is a sum of plain stumps; a forest's mean lies within its leaves' means."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, 240).astype(float)
    y = np.where(x > 6, 2.0, -1.0) + np.where(x > 2, 0.7, 0.0) + rng.normal(size=240) * 0.05
    df = spark.createDataFrame([(float(a), 0.0, 0.0, float(b), "fit" if i < 200 else "test") for i, (a, b) in enumerate(zip(x, y, strict=True))], "x1 double, x2 double, x3 double, y double, part string")
    got = np.array([r.pred for r in model_queries.fitted(GBTRegressor(maxIter=3, maxDepth=1, stepSize=0.5, seed=1), df, "y").collect()])
    left, total = y[:200].copy(), np.zeros(240)
    for k in range(3):  # the first tree counts whole, later ones by the step; residuals are scaled by the loss's gradient of 2
        t, a, b = stump(x[:200], left if k == 0 else 2 * left)
        step = np.where(x <= t, a, b) * (1.0 if k == 0 else 0.5)
        total += step
        left = y[:200] - total[:200]
    assert np.allclose(got, total, atol=1e-6)
    forest = np.array([r.pred for r in model_queries.fitted(RandomForestRegressor(numTrees=15, maxDepth=2, seed=0), df, "y").collect()])
    assert np.corrcoef(forest, total)[0, 1] > 0.97 and forest.min() >= y[:200].min() and forest.max() <= y[:200].max()


def test_second_model_sees_what_the_first_leaves(spark):
    got = model_queries.ml_04(spark, WHERE.replace("0.001", "0.01")).toPandas()
    assert list(got["model"]) == ["trees", "second"] and got["r2"].nunique() == 1 and 0 < got["r2"][0] < 1
    assert isinstance(got, pd.DataFrame)
