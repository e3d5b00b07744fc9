"""Pairs of rows that share a key, in tasks of bounded size however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pairs(x: DataFrame, keys: list[str], item: str, held: list[str] | None = None, rows: int = 1000) -> DataFrame:
    """(*keys, a, b, *held) for each two rows of a key with items a < b; items of a key are distinct; held columns are a's.

    A key of up to `rows` items is one task. A larger one is cut into blocks of items by a hash, and each block meets itself
    and every other one in a task of its own, so a key that holds a third of all items is spread over many tasks.
    """
    held = held or []
    n = F.count("*").over(Window.partitionBy(*keys))
    x = x.withColumn("_blocks", F.ceil(n / rows).cast("int")).withColumn("_home", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
    sent = x.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumns({"_lo": F.least("_home", "_other"), "_hi": F.greatest("_home", "_other")})
    left = sent.select(*keys, "_lo", "_hi", F.col("_home").alias("_ha"), F.col(item).alias("a"), *held)
    right = sent.select(*keys, "_lo", "_hi", F.col("_home").alias("_hb"), F.col(item).alias("b"))
    # two items of one block also meet where that block is with another one; they count in its own task alone
    return left.join(right, [*keys, "_lo", "_hi"]).where("a < b and (_lo = _hi or _ha <> _hb)").select(*keys, "a", "b", *held)


def mirrored(two: DataFrame) -> DataFrame:
    """Pairs (a, b) both ways."""
    turned = two.select(*(F.col({"a": "b", "b": "a"}.get(c, c)).alias(c) for c in two.columns))
    return two.unionByName(turned)
