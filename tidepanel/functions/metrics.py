"""Performance of return streams (stream_id, di, r): one row per stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drawdown(r: DataFrame, by: str = "stream_id", order: str = "di") -> DataFrame:
    """r plus equity and drawdown; the peak starts at the first equity value."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    e = r.withColumn("equity", F.product(1 + F.col("r")).over(w))
    return e.withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(w))


def cvar(r: DataFrame, beta: float, by: str = "stream_id") -> DataFrame:
    """(by, cvar): mean of the losses at or over their linear beta-quantile."""
    losses = r.select(by, (-F.col("r")).alias("loss"))
    q = losses.groupBy(by).agg(F.percentile("loss", beta).alias("q"))
    return losses.join(q, by).where("loss >= q").groupBy(by).agg(F.avg("loss").alias("cvar"))


def metrics(r: DataFrame, by: str = "stream_id", rf: float = 0.04, year: int = 252, least: int = 30) -> DataFrame:
    """(by, cr, sr, hr, mdd): compounded return, Sharpe over the risk-free rate, hit rate, worst drawdown."""
    x = F.col("r") - rf / year
    sharpe = F.when((F.count("r") >= least) & (F.stddev_pop("r") >= 1e-12), F.avg(x) / F.stddev_pop(x) * year**0.5)
    base = r.groupBy(by).agg((F.product(1 + F.col("r")) - 1).alias("cr"), sharpe.alias("sr"), F.avg((F.col("r") > 0).cast("double")).alias("hr"))
    return base.join(drawdown(r, by).groupBy(by).agg(F.max("drawdown").alias("mdd")), by)


def stat_row(r: DataFrame, by: str = "stream_id", beta: float = 0.85, year: int = 252) -> DataFrame:
    """(by, ann, vol, sharpe, mdd, cvar): yearly mean and deviation (ddof 0), their ratio, drawdown and tail loss."""
    vol = F.stddev_pop("r") * year**0.5
    base = r.groupBy(by).agg((F.avg("r") * year).alias("ann"), vol.alias("vol"), (F.avg("r") * year / F.nullif(vol, F.lit(0.0))).alias("sharpe"))
    return base.join(drawdown(r, by).groupBy(by).agg(F.max("drawdown").alias("mdd")), by).join(cvar(r, beta, by), by)
