"""Linear models from moments: one pass over the rows gives sums of products, all else is algebra on as many numbers as features squared."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Of n rows: means of features and target, and centred sums of products xx, xy, yy."""

    n: float
    mean: np.ndarray
    target: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float


def moments(rows: DataFrame, part: str, features: str, target: str, width: int) -> dict:
    """Moments for each value of `part`, from an array column of `width` doubles without nulls and a double column.

    Each task sums its rows by blocks; the sums meet in one aggregation, so the driver gets (width + 2) ** 2 numbers for each part.
    """
    side = width + 2
    kind = rows.schema[part].dataType

    def sums(batches):
        found: dict = {}
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist(), object)
            x = np.asarray(batch.column(1).flatten(), float).reshape(-1, width)
            z = np.column_stack([np.ones(len(x)), x, np.asarray(batch.column(2), float)])
            for p in set(parts.tolist()):
                some = z[parts == p]
                found[p] = found.get(p, 0) + some.T @ some
        for p, m in found.items():
            yield pa.RecordBatch.from_pydict({"part": [p] * (side * side), "cell": np.arange(side * side, dtype=np.int32), "value": m.ravel()})

    cells = rows.select(part, features, target).mapInArrow(sums, f"part {kind.simpleString()}, cell int, value double").groupBy("part", "cell").agg(F.sum("value").alias("value"))
    raw: dict = {}
    for row in cells.collect():
        raw.setdefault(row.part, np.zeros(side * side))[row.cell] = row.value
    return {p: _centred(m.reshape(side, side)) for p, m in raw.items()}


def _centred(m: np.ndarray) -> Moments:
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    c = m[1:, 1:] - n * np.outer(mean, mean)
    return Moments(n, mean[:-1], mean[-1], c[:-1, :-1], c[:-1, -1], c[-1, -1])


def ridge(m: Moments, alpha: float, standard: bool = False) -> tuple[np.ndarray, float]:
    """(weights, intercept); with `standard` the penalty is on features over their deviation (ddof 0)."""
    scale = np.sqrt(np.diag(m.xx) / m.n) if standard else np.ones(len(m.xy))
    scale = np.where(scale > 0, scale, 1.0)
    w = np.linalg.solve(m.xx / np.outer(scale, scale) + alpha * np.eye(len(scale)), m.xy / scale) / scale
    return w, m.target - w @ m.mean


def squared_error(m: Moments, w: np.ndarray, intercept: float) -> float:
    """Mean squared error on the rows of m."""
    return (m.yy - 2 * w @ m.xy + w @ m.xx @ w) / m.n + (m.target - w @ m.mean - intercept) ** 2


def partial_least_squares(m: Moments, k: int = 8) -> tuple[np.ndarray, float]:
    """(weights, intercept) of k components, each along what is left of the covariance with the target."""
    left, directions, loadings, w = m.xy.copy(), [], [], np.zeros(len(m.xy))
    for _ in range(min(k, len(left))):
        size = np.linalg.norm(left)
        if size < 1e-12 * max(1.0, np.linalg.norm(m.xy)):
            break
        r = left / size
        for p, q in zip(loadings, directions, strict=True):
            r = r - (p @ (left / size)) * q
        spread = r @ m.xx @ r
        p, gain = m.xx @ r / spread, (r @ m.xy) / spread
        left = left - p * gain * spread
        w = w + gain * r
        loadings.append(p)
        directions.append(r)
    return w, m.target - w @ m.mean


def predicted(features: str, w: np.ndarray, intercept: float):
    """The prediction as a column over an array column."""
    parts = F.zip_with(features, F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b)
    return F.aggregate(parts, F.lit(float(intercept)), lambda a, x: a + x)
