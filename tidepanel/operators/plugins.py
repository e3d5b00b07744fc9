"""Hooks for a user's own code: signal providers, sizing schemes and rewards, each a function over DataFrames or columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Provider(Protocol):
    """Gives (date, ticker, weight) of the dates wanted from a panel (date, di, ticker, close, ...)."""

    def __call__(self, panel: DataFrame, dates: DataFrame) -> DataFrame: ...


def provided(providers: dict[str, Provider], panel: DataFrame, dates: DataFrame) -> DataFrame:
    """(provider, date, ticker, weight): weights under 0 or missing are 0, and a date's weights sum to 1, or to 0 for all cash.

    A provider without one of the three columns is refused; dates that weren't wanted are left out.
    """
    out = []
    for name, provider in providers.items():
        got = provider(panel, dates)
        lacking = {"date", "ticker", "weight"} - set(got.columns)
        if lacking:
            raise ValueError(f"provider {name} gives no {', '.join(sorted(lacking))}")
        out.append(got.join(dates, "date", "left_semi").select(F.lit(name).alias("provider"), "date", "ticker", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")))
    total = F.sum("weight").over(Window.partitionBy("provider", "date"))
    return reduce(DataFrame.unionByName, out).withColumn("weight", F.col("weight") / F.when(total > 0, total).otherwise(1.0))


def scheme_weights(x: DataFrame, schemes: dict[str, Column | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(scheme, di, ticker, weight) of x (di, ticker, s, v, ...): a scheme is an expression, or a function of x giving (di, ticker, weight).

    A day's absolute weights sum to 1; 0 where all are 0 or missing.
    """
    plain = {k: e for k, e in schemes.items() if isinstance(e, Column)}
    out = [f(x).select(F.lit(k).alias("scheme"), "di", "ticker", F.col("weight").cast("double")) for k, f in schemes.items() if k not in plain]
    if plain:
        each = F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), e.cast("double").alias("weight")) for k, e in plain.items())))
        out.append(x.select("di", "ticker", each.alias("z")).select("z.scheme", "di", "ticker", "z.weight"))
    gross = F.nullif(F.sum(F.abs("weight")).over(Window.partitionBy("scheme", "di")), F.lit(0.0))
    return reduce(DataFrame.unionByName, out).withColumn("weight", F.coalesce(F.col("weight") / gross, F.lit(0.0)))


def scored(answers: DataFrame, key: str, rewards: dict[str, Column]) -> DataFrame:
    """(key, reward, score): every reward, an expression over the columns of answers, for every row."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("reward"), e.cast("double").alias("score")) for k, e in rewards.items())))
    return answers.select(key, each.alias("z")).select(key, "z.reward", "z.score")
