"""Hard negatives against a plain double loop: blocks, ties, signs, odd rows, values beyond doubles' whole numbers."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score double, q string, block int"


def plain(rows, anchors, positives=5, negatives_=10, low=30, high=90):
    """rows and anchors: (id, label, whole components)."""
    out = []
    for a, label, v in anchors:
        score = lambda r: sum(x * y for x, y in zip(v, r[2], strict=True))  # noqa: B023, E731
        others = [(-score(r), r[0], r[1]) for r in rows if r[0] != a and len(r[2]) == len(v)]
        for s, p, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fit = sorted(x for x in others if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:negatives_]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    assert (low, high) == (30, 90)
    return sorted(out)


def whole(rows):
    return [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def found(spark, rows, n_blocks=None):
    df = spark.createDataFrame(rows, SCHEMA).select(F.col("vec_id").alias("id"), "label", negatives.quantised("embedding").alias("q"))
    if n_blocks is None:
        got = negatives.hard_negatives(df, df.where("id % 10 = 0"))
        return sorted(map(tuple, got.collect()))
    sound = df.where("id is not null and label is not null and q is not null").withColumn("label", F.col("label").cast("long"))
    one = sound.where("id % 10 = 0").withColumn("wanted", F.expr("array(struct(0L as name, 0L as score))"))
    near = negatives.threshold_search(sound, one, 5, True, n_blocks=n_blocks)
    wanted = near.groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("name"), "score")).alias("wanted"))
    far = negatives.threshold_search(sound, one.drop("wanted").join(wanted, "id"), 10, False, (30, 90), n_blocks)
    return sorted(map(tuple, far.select("id", "name", "rank", "other", "given", "score").collect()))


def test_equals_double_loop(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] * rng.uniform(0, 1) + rng.normal(size=12) * 0.6], int(rng.integers(4)), 0.1, "q", 1) for i in range(400)]
    rows += [(400 + i, [float(x) for x in rng.integers(-1, 2, 12) / 256], int(i % 3), None, None, None) for i in range(200)]  # ties
    rows += [(610, [0.0] * 12, 1, None, None, None), (620, [0.5, -0.5], 1, None, None, None), (621, [0.5, 0.5], 1, None, None, None), (622, [0.4, -0.1], 2, None, None, None), (630, [], 1, None, None, None), (631, [], 1, None, None, None), (632, [], 2, None, None, None)]
    rows += [(640, None, 1, None, None, None), (650, [float("nan")] * 12, 1, None, None, None), (660, [None] * 12, 1, None, None, None), (670, [0.1] * 12, None, None, None, None), (None, [0.1] * 12, 1, None, None, None)]
    rows += [(680, rows[3][1], 2, None, None, None), (690, rows[3][1], 2, None, None, None), (691, rows[3][1], 2, None, None, None)]  # copies
    sound = whole(rows)
    expected = plain(sound, [r for r in sound if r[0] % 10 == 0])
    assert len(expected) > 500
    assert found(spark, rows) == expected
    assert found(spark, rows, 7) == expected  # several blocks, the best of each ranked together


def test_repeated_ids_and_none(spark):
    a, b = [0.5, 0.1], [0.4, 0.2]
    rows = [(10, a, 1, 0.0, "", 0)] * 2 + [(11, b, 1, 0.0, "", 0)] * 2 + [(12, [0.3, 0.1], 2, 0.0, "", 0)] * 2
    got = found(spark, rows)
    assert [r[:4] for r in got] == [(10, 11, 1, 12)]
    assert found(spark, []) == []


def test_large_components(spark):
    """Products beyond 2**53 are summed as whole numbers."""
    rows = [(10, [4e6, 3.0, -2.0], 1, None, None, None), (11, [4e6, 1.0, 1.0], 1, None, None, None), (12, [2e6, 7.0, 1.0], 2, None, None, None), (13, [2e6, 7.00390625, 1.0], 2, None, None, None), (14, [1e30, 0.0, 0.0], 3, None, None, None)]
    sound = [r for r in whole(rows) if r[0] != 14]
    got = found(spark, rows[:4])
    assert [r[:4] for r in got] == [r[:4] for r in plain(sound, sound[:1])]
    assert {r[3] for r in found(spark, rows)} <= {12, 13, 14}


def test_stops_early():
    """On lists whose values fall quickly few rows are scored, and the rows are right."""
    rng = np.random.default_rng(1)
    q = np.floor(256 * rng.pareto(1.2, (5000, 4))).astype(np.int64)
    here, met = negatives.Lists(np.arange(5000), np.zeros(5000, np.int64), q), []
    scores = here._scores
    here._scores = lambda rows, *a: met.extend(rows) or scores(rows, *a)
    anchor = np.array([3, 1, 0, 2])
    (rows, got), = here.search(anchor, np.ones(5000, bool), [0], [10**9], 10)
    expected = sorted((-(q @ anchor)[i], i) for i in range(5000))[:10]
    assert [(-s, r) for r, s in zip(rows, got, strict=True)] == expected and len(met) < 1500
