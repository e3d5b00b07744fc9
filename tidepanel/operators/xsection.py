"""Cross-sections by date: ranks, legs, terciles, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, by: str = "di") -> Column:
    """Rank with ties averaged, among non-null values."""
    w = Window.partitionBy(by, F.col(value).isNull())
    ties = Window.partitionBy(by, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2)


def pct_rank(value: str, by: str = "di") -> Column:
    return average_rank(value, by) / F.count(value).over(Window.partitionBy(by))


def rank_z(s: DataFrame, value: str, name: str, by: str = "di") -> DataFrame:
    """s plus the rank, standardised by date (sample deviation)."""
    w = Window.partitionBy(by)
    r = s.withColumn("_r", average_rank(value, by))
    return r.withColumn(name, (F.col("_r") - F.avg("_r").over(w)) / F.nullif(F.stddev_samp("_r").over(w), F.lit(0.0))).drop("_r")


def exact_product(a: Column, b: Column) -> tuple[Column, Column]:
    """a * b as rounded, and what rounding cut off (by Veltkamp's halves of both)."""

    def halves(x):
        c = x * F.lit(134217729.0)
        high = c - (c - x)
        return high, x - high

    (a1, a2), (b1, b2), product = halves(a), halves(b), a * b
    return product, ((a1 * b1 - product) + a1 * b2 + a2 * b1) + a2 * b2


def legs(s: DataFrame, value: str = "value", by: str = "di", share: float = 0.2) -> DataFrame:
    """s plus up and down: values at or beyond the linear quantiles, so ties enlarge a leg.

    A quantile lies between two neighbours. The lower one's part of it is added unrounded, as by a fused multiply-add (and so by
    DuckDB), for neighbours that are equal but for the last bits of their sums may else fall on either side of it.
    """
    w = Window.partitionBy(by)
    v = F.col(value).cast("double")
    x = s.withColumns({"_n": F.count(value).over(w), "_at": F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())) - 1})
    for q, k in ((1 - share, "up"), (share, "down")):
        place = (F.col("_n") - 1) * F.lit(q)
        x = x.withColumns({f"_{e}": F.max(F.when(F.col("_at") == edge(place), v)).over(w) for e, edge in (("lo", F.floor), ("hi", F.ceil))} | {"_part": place - F.floor(place)})
        low, cut = exact_product(F.col("_lo"), 1 - F.col("_part"))
        high = F.col("_hi") * F.col("_part")
        total = low + high
        back = total - low
        rest = (low - (total - back)) + (high - back) + cut
        between = total + F.nanvl(rest, F.lit(0.0))
        x = x.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between))
        x = x.withColumn(k, F.col(value) >= F.col("_q") if k == "up" else F.col(value) <= F.col("_q"))
    return x.drop("_n", "_at", "_lo", "_hi", "_part", "_q")


def terciles(value: str, tie: str = "ticker", by: str = "di") -> Column:
    """0, 1 or 2: thirds by rank, ties in the order of `tie`; sizes as linear quantile edges give them."""
    n = F.count(value).over(Window.partitionBy(by))
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last(), tie))
    return F.when(F.col(value).isNull(), None).when(rn <= F.floor((n + 1) / 3), 0).when(rn > n - F.ceil(n / 3), 2).otherwise(1)


def residual_rank(s: DataFrame, y: str, x: str, by: str = "di") -> DataFrame:
    """Residual of the standardised rank of y on that of x, without a constant."""
    w = Window.partitionBy(by)
    z = rank_z(rank_z(s, y, "_y", by), x, "_x", by)
    beta = F.sum(F.col("_x") * F.col("_y")).over(w) / F.nullif(F.sum(F.when(F.col("_y").isNotNull(), F.col("_x") * F.col("_x"))).over(w), F.lit(0.0))
    return z.withColumn("residual", F.col("_y") - beta * F.col("_x")).drop("_x", "_y")


def residual_ols(s: DataFrame, y: str, x1: str, x2: str, least: int, by: str = "di") -> DataFrame:
    """Residual of y on a constant, x1 and x2 by date, from windowed sums; null with few names or a singular fit."""
    w = Window.partitionBy(by)
    full = s.where(f"{y} is not null and {x1} is not null and {x2} is not null")
    d = full.select("*", *((F.col(c) - F.avg(c).over(w)).alias(f"_{k}") for k, c in (("y", y), ("1", x1), ("2", x2))), F.count("*").over(w).alias("_n"))
    dot = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}")).over(w)
    d = d.select("*", *(dot(a, b).alias(f"_{a}{b}") for a, b in ("11", "22", "12", "1y", "2y")))
    det = F.expr("_11 * _22 - _12 * _12")
    fit = F.col("_y") - (F.expr("_1y * _22 - _2y * _12") * F.col("_1") + F.expr("_2y * _11 - _1y * _12") * F.col("_2")) / det
    ok = (F.col("_n") >= least) & (det > 1e-12 * F.col("_11") * F.col("_22"))
    return d.withColumn("residual", F.when(ok, fit)).drop("_y", "_1", "_2", "_n", "_11", "_22", "_12", "_1y", "_2y")
