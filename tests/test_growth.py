"""Steps whose cost or result went wrong on larger tables."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidepanel.operators import context as C
from tidepanel.streaming import jobs


def plan(df) -> str:
    """The plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_an_uncapped_bucket_are_never_broadcast(spark):
    day = dt.datetime(2024, 1, 1)
    asked = spark.createDataFrame([("a", "", "news", day + dt.timedelta(days=40))], "name string, key string, kind string, as_of timestamp_ntz")
    items = spark.range(500).select(F.lit("a").alias("name"), F.lit("").alias("key"), F.lit("news").alias("kind"), (F.lit(day).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id"))).alias("ts"), F.col("id").alias("tie"), F.col("id").alias("item"))
    got = C.newest(asked, items, {"news": C.RICH})
    ran = plan(got)
    assert "SortMergeJoin" in ran and "BroadcastHashJoin" not in ran
    assert sorted(r.item for r in got.collect()) == list(range(500))


def test_items_out_of_reach_stay_out_of_the_timeline(spark):
    day, name = dt.datetime(2024, 1, 1), "name string, key string, kind string, "
    asked = spark.createDataFrame([(n, "", k, day + dt.timedelta(days=d)) for n, d in (("a", 100), ("a", 130), ("b", 300)) for k in ("news", "macro")], name + "as_of timestamp_ntz")
    rows = [(n, "", k, day + dt.timedelta(hours=h), h, h) for n in "abc" for k in ("news", "macro") for h in range(0, 400 * 24, 12)]
    items = spark.createDataFrame(rows, name + "ts timestamp_ntz, tie long, item long")
    of = {"news": [C.Bucket("", C.NOW, C.Edge(4), 3), C.Bucket("", C.Edge(4), C.Edge(30, True), None)], "macro": C.LATEST}
    assert {(r.name, r.kind): (r.lo, r.hi) for r in C.within_reach(asked, items, of).groupBy("name", "kind").agg(F.min("item").alias("lo"), F.max("item").alias("hi")).collect()} == {
        ("a", "news"): (70 * 24, 130 * 24), ("a", "macro"): (0, 130 * 24), ("b", "news"): (270 * 24, 300 * 24), ("b", "macro"): (0, 300 * 24)}
    got = {}
    for r in C.newest(asked, items, of).collect():
        got.setdefault((r.name, r.kind, (r.as_of - day).days, r.bucket), []).append((r.back, r.item))
    for n, d in (("a", 100), ("a", 130), ("b", 300)):
        hours = [h for h in range(0, 400 * 24, 12) if h <= d * 24][::-1]
        old = [h for h in hours if (d - 30) * 24 <= h <= (d - 4) * 24]
        assert sorted(got[n, "news", d, 0]) == list(enumerate(hours[:3])) and sorted(got[n, "news", d, 1]) == list(enumerate(old)) and got[n, "macro", d, 0] == [(0, hours[0])]


def test_waiting_events_lie_in_blocks():
    at, ids = np.arange(3 * jobs.BLOCK + 5, dtype="int64") * 7, np.arange(3 * jobs.BLOCK + 5, dtype="int64") + 2**60
    blocks = jobs.packed(at, ids)
    assert len(blocks) == 4
    assert (jobs.unpacked(iter(blocks)) == np.stack([at, ids])).all()
    assert jobs.unpacked(iter(())).shape == (2, 0)


def test_large_ids_beside_facts_stay_whole(spark, tmp_path):
    day, big = dt.datetime(2024, 1, 2), 2**60 + 1
    rows = [(1, day, None, "a"), (1, day + dt.timedelta(hours=1), big, None), (1, day + dt.timedelta(days=9), 5, None), (2, day, big + 2, None)]
    spark.createDataFrame(rows, "key long, ts timestamp, id long, fact string").write.parquet(f"{tmp_path}/source")
    with jobs.settings(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        out = jobs.known_then(spark.readStream.schema("key long, ts timestamp, id long, fact string").parquet(f"{tmp_path}/source"))
        jobs.run_to_table(out, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table").collect())) == [(1, big, "a"), (2, big + 2, None)]
