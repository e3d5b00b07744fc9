"""Places in a total order, ranks and capped choices without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.sources.files import stored


def _met(kept: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """kept with the columns of its runs, a row a key and partition; null keys are keys too."""
    named = runs.withColumnsRenamed({c: f"_of_{c}" for c in (*by, "_part")})
    on = F.col("_part") == F.col("_of__part")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return kept.join(named, on).drop(*(f"_of_{c}" for c in (*by, "_part")))


def numbered(df: DataFrame, order: list[str], name: str = "pos", by: str | None = None) -> DataFrame:
    """df plus each row's place from 0 in the order (of its key), which should be total.

    Rows are range-partitioned and sorted; a place is the row's number in its partition plus the rows of partitions before. Only
    the second takes a window, over a row a partition (and key).
    """
    keys = [by] if by else []
    ordered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kept = stored(ordered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_row", 33)), "numbered")
    runs = kept.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_past", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return _met(kept, runs, keys).select(*df.columns, (F.col("_row") - F.col("_first") + F.col("_past")).alias(name))


def running(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df plus the running sum of a value over each key's rows in order, the row's own counted.

    Keys of any size are spread: rows are range-partitioned, sums run within partitions and start from those of the key's
    partitions before.
    """
    kept = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "running")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = kept.groupBy(*by, "_part").agg(F.sum(value).alias("_sum")).withColumn("_past", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _met(kept.withColumn(name, F.sum(value).over(within)), runs, by).withColumn(name, F.col(name) + F.col("_past")).drop("_part", "_past")


def carried(df: DataFrame, by: list[str], order: list[str], value: str, backward: bool = False) -> DataFrame:
    """df with the last value so far (backward: the next one), nulls passed over, in each key's order; the row's own counts.

    As `running`: a key of any size is spread over range partitions, and each starts from what the partitions before end with.
    """
    kept = stored(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "carried")
    there = F.when(F.col(value).isNotNull(), F.struct(*order))
    runs = kept.groupBy(*by, "_part").agg((F.min_by if backward else F.max_by)(value, there).alias("_end"))
    part, rows = (F.desc("_part") if backward else F.asc("_part")), Window.partitionBy(*by)
    runs = runs.withColumn("_past", F.last("_end", ignorenulls=True).over(rows.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    turn = F.desc if backward else F.asc
    within = Window.partitionBy(*by, "_part").orderBy(*map(turn, order)).rowsBetween(Window.unboundedPreceding, 0)
    return _met(kept.withColumn("_own", F.last(value, ignorenulls=True).over(within)), runs, by).withColumn(value, F.coalesce("_own", "_past")).drop("_part", "_past", "_own")


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (stored) with rank_<c> for each column: its average rank among all rows; columns hold no nulls.

    All columns are ranked in one go: counts of their distinct values lie in one range-partitioned order, and running sums within
    partitions start from the sums of the partitions before.
    """
    kept = stored(df, "ranked")
    values = kept.select(F.explode(F.array(*(F.struct(F.lit(k).alias("c"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)))).alias("x"))
    counts = values.groupBy("x.c", "x.v").agg(F.count("*").alias("k"))
    parts = stored(counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "counts")
    w = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy("c", "part").agg(F.sum("k").alias("all")).withColumn("base", F.coalesce(F.sum("all").over(w), F.lit(0))).drop("all")
    up = F.sum("k").over(Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = parts.withColumn("up", up).join(base, ["c", "part"]).select("c", "v", (F.col("base") + F.col("up") - (F.col("k") - 1) / 2).alias("rank"))
    for k, c in enumerate(columns):
        kept = kept.join(ranks.where(F.col("c") == k).select(F.col("v").alias(f"_{c}"), F.col("rank").alias(f"rank_{c}")), F.col(c).cast("double") == F.col(f"_{c}")).drop(f"_{c}")
    return kept


def places(x: DataFrame, cls: str, day: str) -> DataFrame:
    """x plus `before` (rows of the class on earlier days), `held` (rows of it on this day) and `n` (all of it).

    Counts by class and day are few; the windows run over these alone, whatever the size of a class.
    """
    c = x.groupBy(cls, day).agg(F.count("*").alias("held"))
    w = Window.partitionBy(cls)
    earlier = w.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumns({"before": F.coalesce(F.sum("held").over(earlier), F.lit(0)), "n": F.sum("held").over(w)})
    return x.join(c, [cls, day])


def first_of_each(x: DataFrame, caps: DataFrame, cls: str, day: str, tie: str) -> DataFrame:
    """The first `cap` rows of each class by day and tie; caps (class, cap).

    Days before the border come whole; only the border day, where the cap falls, is ranked.
    """
    placed = places(x, cls, day).join(F.broadcast(caps), cls).where("before < cap")  # a row a class
    whole = placed.where("before + held <= cap")
    cut = placed.where("before + held > cap").withColumn("_k", F.row_number().over(Window.partitionBy(cls, day).orderBy(tie))).where("_k <= cap - before").drop("_k")
    return whole.unionByName(cut).select(*x.columns)


def every_stride(x: DataFrame, most: int, cls: str, day: str, tie: str) -> DataFrame:
    """About `most` rows of each class at even strides of its order by day and tie, from its first row on.

    Days without a place of the stride go before anything is ranked.
    """
    placed = places(x, cls, day).withColumn("stride", F.greatest(F.floor(F.col("n") / most), F.lit(1)))
    # the first place of the stride at or after the day's first row lies on the day
    hit = placed.where("ceil(before / stride) * stride < before + held and ceil(before / stride) < %d" % most)
    at = F.col("before") + F.row_number().over(Window.partitionBy(cls, day).orderBy(tie)) - 1
    return hit.withColumn("_at", at).where(f"_at % stride = 0 and floor(_at / stride) < {most}").select(*x.columns)
