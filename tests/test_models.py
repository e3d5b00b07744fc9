"""Solvers, fitted models, rewards and hooks against plain versions; cases that SQL can't express."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import linear as L
from tidepanel.operators import plugins as U
from tidepanel.operators import rewards as RW
from tidepanel.operators import risk as R
from tidepanel.plans import model_queries as M
from tidepanel.streaming import jobs

WHERE = "/root/testdata/sf0.001"


def plain_regime(loss, beta=0.85, alpha=0.005, gamma=0.05, window=250, warmup=60):
    """The controller day by day with lists; also the days on which the buffer was not 0."""
    n = len(loss)
    dev = [np.std(loss[t - 21 : t], ddof=1) if t >= 21 else math.nan for t in range(n)]
    size = [np.mean(np.abs(loss[t - 5 : t])) if t >= 5 else math.nan for t in range(n)]

    def standard(v, t):
        past = [x for x in v[:t] if not math.isnan(x)]
        if len(past) < 30:
            return math.nan
        sd = np.std(past, ddof=1)
        return (v[t] - np.mean(past)) / sd if sd > 0 else math.nan

    z = [(standard(dev, t), standard(size, t)) for t in range(n)]
    low, high = np.quantile(loss[:60], [0.01, 0.99])
    scale, c, q, x = max(high - low, 1e-6), 0.0, 0.0, 1.0
    out, scores, used = [], [], 0
    for t, y in enumerate(loss):
        real, buffer = x * y, 0.0
        out.append((x, real))
        past = [i for i in range(max(0, t - window), t) if not any(map(math.isnan, z[i]))]
        if len(past) >= warmup and not any(map(math.isnan, z[t])):
            aged = [0.5 ** ((t - i) / 60) for i in past]
            w = [a * math.exp(-min((z[i][0] - z[t][0]) ** 2 + (z[i][1] - z[t][1]) ** 2, 700) / 0.5) for a, i in zip(aged, past)]
            if sum(w) == 0 or sum(w) ** 2 / sum(v * v for v in w) < 15:
                w = aged
            rank, seen = min(1, beta * (1 + 1 / max(sum(w), 1e-9))), 0.0
            ordered = sorted(zip([scores[i] for i in past], w))
            buffer = ordered[-1][0]
            for s, v in ordered:
                seen += v
                if seen / sum(w) >= rank:
                    buffer = s
                    break
            used += 1
        scores.append(real - c)
        raised = c + buffer
        penalised = raised + max(real - raised, 0) / (1 - beta)
        g = 1 - (real > c) / (1 - beta)
        q += g * g
        c = min(max(c - scale * g / (2 * math.sqrt(q)), low), high)
        x = min(max(x - gamma * (penalised - alpha) / scale, 0), 1)
    return out, used


def test_regime_controller_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0.002, 0.02, 320) * np.where(np.arange(320) // 60 % 2, 2.5, 1)
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(r)], "stream_id string, di int, r double")
    grid = spark.createDataFrame([(0.005, 0.05)], "alpha double, gamma double")
    got = R.regime_controlled(rows, grid).orderBy("di").collect()
    expected, used = plain_regime(list(-r))
    assert used > 100
    assert np.allclose([(g.exposure, g.realized) for g in got], expected, atol=1e-9)


def test_regime_controller_without_history_is_the_plain_one(spark):
    rows = spark.createDataFrame([("s", i, 0.01 * math.sin(i)) for i in range(70)], "stream_id string, di int, r double")
    grid = spark.createDataFrame([(0.005, 0.05), (0.01, 0.1)], "alpha double, gamma double")
    assert sorted(R.regime_controlled(rows, grid).collect()) == sorted(R.controlled(rows, grid).collect())


def test_streamed_controller_equals_the_batch_one_over_two_deliveries(spark, tmp_path):
    rows = [(f"s{k}", i, 0.02 * math.sin(k + i)) for k in range(3) for i in range(100)]
    schema = "stream_id string, di int, r double"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (range(0, 40), range(40, 100)):
        spark.createDataFrame([r for r in rows if r[1] in part], schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = jobs.controlled(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        jobs.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/check")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    grid = spark.createDataFrame([(0.005, 0.05)], "alpha double, gamma double")
    expected = R.controlled(spark.createDataFrame(rows, schema), grid).select("stream_id", "di", "exposure", "realized")
    assert sorted(spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(expected.collect())


def test_mean_variance_equals_numpy(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(0, 0.02, (90, 4))
    rows = [(i, k, float(i + k) % 5 - 2, float(r[i, k])) for i in range(90) for k in range(4)]
    x = spark.createDataFrame([*rows, (80, 9, 1.0, None), (81, 9, None, 0.1)], "di int, ticker int, score double, r double")
    got = {(v.di, v.ticker): v.weight for v in R.mean_variance(x).collect()}
    for d in (25, 61, 89):
        cov = np.cov(r[max(0, d - 60) : d].T)
        w = np.linalg.solve(0.7 * cov + 0.3 * np.diag(np.diag(cov)) + 1e-4 * np.eye(4), [(d + k) % 5 - 2 for k in range(4)])
        assert np.allclose([got[d, k] for k in range(4)], w / np.abs(w).sum())
    assert got[5, 0] == got[80, 9] == got[81, 9] == 0


def test_moments_ridge_and_least_squares_equal_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(3, 1, (300, 6)) * np.arange(1, 7)
    y = x @ rng.normal(size=6) + rng.normal(size=300)
    rows = spark.createDataFrame([("a" if i % 3 else "b", list(map(float, x[i])), float(y[i])) for i in range(300)], "part string, x array<double>, y double").repartition(5)
    m = L.moments(rows, "part", "x", "y", 6)
    a = np.arange(300) % 3 > 0
    xc, yc = x[a] - x[a].mean(0), y[a] - y[a].mean()
    w, b = L.ridge(m["a"], 10.0)
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + 10 * np.eye(6), xc.T @ yc))
    assert np.isclose(L.squared_error(m["b"], w, b), np.mean((x[~a] @ w + b - y[~a]) ** 2))
    # components by deflating the rows themselves
    e, f, ws, ps, qs = xc.copy(), yc.copy(), [], [], []
    for _ in range(3):
        d = e.T @ f / np.linalg.norm(e.T @ f)
        t = e @ d
        p, q = e.T @ t / (t @ t), f @ t / (t @ t)
        e, f = e - np.outer(t, p), f - q * t
        ws.append(d), ps.append(p), qs.append(q)
    W, Q = np.array(ws).T, np.array(ps).T
    assert np.allclose(L.partial_least_squares(m["a"], 3)[0], W @ np.linalg.solve(Q.T @ W, qs))
    found = rows.select(L.predicted("x", w, b).alias("p"), "x").collect()
    assert np.allclose([v.p for v in found], [np.dot(v.x, w) + b for v in found])


def test_components_are_those_of_the_fitted_vectors(spark):
    got = {r.vec_id: r.pca for r in M.ml_05(spark, WHERE, 4).collect()}
    rows = M.vectors(spark, WHERE).collect()
    train = np.array([r.x for r in rows if r.side == "train"])
    _, _, axes = np.linalg.svd(train - train.mean(0), full_matrices=False)
    expected = (np.array([r.x for r in rows]) - train.mean(0)) @ axes[:4].T
    assert np.allclose(np.abs([got[r.vec_id] for r in rows]), np.abs(expected), atol=1e-6)


def test_fitted_trees_beat_chance_and_placebos_keep_values(spark):
    where = WHERE.replace("0.001", "0.01")
    x = M.fitted(M.trees(), M.examples(spark, where), "y")
    assert M.scores(x, "trees").first().ic > 0.2
    rows = M.ml_07(spark, where).collect()
    assert sorted(r.value for r in rows) == sorted(r.placebo for r in rows)
    assert abs(np.corrcoef([r.value for r in rows], [r.placebo for r in rows])[0, 1]) < 0.1


def test_rewards_of_hand_made_answers(spark):
    opinion = " ".join(["word"] * 20)
    good = f"- {opinion} *a quotation* `paper`"
    answer = "\n".join(f"## Part {i}\n" + "\n".join([good] * 4) for i in range(5)) + "\n# Conclusion\nBUY"
    texts = {1: answer, 2: "", 3: None, 4: "no header\n- point", 5: "# One\n- short `s`\n#\nx", 6: "# think\n" + good}
    rows = spark.createDataFrame(list(texts.items()), "id int, text string")
    got = {r.id: (round(r.s, 6), round(r.e, 6)) for r in rows.select("id", RW.structure_reward(F.col("text")).alias("s"), RW.evidence_reward(F.col("text")).alias("e")).collect()}
    assert got[1] == (round(0.6 + 0.4 * 0.4, 6), 1.0)
    assert got[2] == got[3] == got[4] == got[6] == (0.0, 0.0)
    # one section; its bullet has two words before any quotation, and a source
    assert got[5] == (round(0.6 * 0.3 + 0.4 * 0.2, 6), round(0.3 / 4 + 0.7 * (0.4 * 0.04 + 0.25), 6))


def test_a_provider_without_weights_is_refused(spark):
    panel = spark.sql("SELECT date'2024-01-01' AS date, 1 AS ticker, 2.0D AS close")
    with pytest.raises(ValueError, match="weight"):
        U.provided({"bad": lambda p, d: p}, panel, panel.select("date"))
    cash = U.provided({"short": lambda p, d: p.withColumn("weight", F.lit(-1.0))}, panel, panel.select("date")).first()
    assert cash.weight == 0
