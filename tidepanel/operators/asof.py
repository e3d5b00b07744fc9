"""As-of joins: each row of the left meets the last (or next) event of its key, with one shuffle and no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.order import carried


def asof(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, values: list[str], direction: str = "backward", inclusive: bool = True, tolerance_days: int | None = None, tie: str | None = None, spread: bool = False) -> DataFrame:
    """left plus right's values and `matched`, the time of the event found (null if none).

    backward takes the latest event at or before left_ts (before it, if not inclusive), forward the earliest at or after
    it. tolerance_days drops older finds. Of events of one time the one of the largest `tie` counts.

    With `spread` a key may hold any share of the rows: they are range-partitioned by key and time, and partitions hand on what
    they end with. Without it a key's rows are one task's, which takes one shuffle less.
    """
    forward = direction == "forward"
    event = F.struct(F.col(right_ts).alias("matched"), *values)
    # events sort before the rows that may see them: tag 0 if inclusive, 2 if not; rows are tag 1
    tag = 0 if inclusive else 2
    ties = F.col(tie).cast("double") if tie else F.lit(0.0)
    events = right.select(*by, F.col(right_ts).alias("at"), F.lit(tag).alias("tag"), ties.alias("tie"), event.alias("event"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("row"))
    rows = left.select(*by, F.col(left_ts).alias("at"), F.lit(1).alias("tag"), F.lit(0.0).alias("tie"), F.lit(None).cast(events.schema["event"].dataType).alias("event"), F.struct(*left.columns).alias("row"))
    both = events.unionByName(rows)
    if spread:
        # forward is the same order from its end: rows before the events of their time, the largest tie first
        both = both.withColumn("tag", -F.col("tag") if forward else F.col("tag"))
        found = carried(both, by, ["at", "tag", "tie"], "event", backward=forward).where("row is not null")
    else:
        order = [F.desc("at") if forward else F.asc("at"), F.asc("tag"), F.desc("tie") if forward else F.asc("tie")]
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("event", F.last("event", ignorenulls=True).over(w)).where("row is not null")
    out = found.select("row.*", "event.*")
    if tolerance_days is not None:
        near = F.abs(F.datediff(F.col(left_ts), F.col("matched"))) <= tolerance_days
        out = out.select(*left.columns, *(F.when(near, F.col(c)).alias(c) for c in ["matched", *values]))
    return out


def latest(keys: DataFrame, items: DataFrame, by: list[str], as_of: str, ts: str, per: list[str], order: list[str]) -> DataFrame:
    """The newest item at or before as_of for each key row and each value of `per`."""
    held = [c for c in items.columns if c not in (*by, *per)]
    dated = items.where(F.col(ts).isNotNull())
    rows = keys.where(F.col(as_of).isNotNull()).join(dated.select(*by, *per).distinct(), by)
    # items sort before the keys that may see them, the newest last
    events = dated.select(*by, *per, F.col(ts).alias("at__"), F.struct(*order).alias("tie__"), F.struct(*held).alias("item__"))
    asked = rows.select(*by, *per, F.col(as_of).alias("at__"), F.struct(*(c for c in keys.columns if c not in by)).alias("key__"))
    w = Window.partitionBy(*by, *per).orderBy("at__", F.col("key__").isNotNull(), "tie__").rowsBetween(Window.unboundedPreceding, 0)
    found = events.unionByName(asked, allowMissingColumns=True).withColumn("item__", F.last("item__", ignorenulls=True).over(w))
    return found.where("key__ is not null and item__ is not null").select(*by, "key__.*", *per, "item__.*")


def window_items(keys: DataFrame, items: DataFrame, by: list[str], as_of: str, ts: str, days: int) -> DataFrame:
    """Items of the `days` days up to as_of. Both sides carry a block of days, so the join stays an equi-join."""
    block = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    asked = keys.withColumn("block", F.explode(F.array(block(F.col(as_of)), block(F.col(as_of)) - 1)))
    return asked.join(items.withColumn("block", block(F.col(ts))), [*by, "block"]).where((F.col(ts) <= F.col(as_of)) & (F.datediff(as_of, ts) <= days)).drop("block")


def on_calendar(events: DataFrame, p: DataFrame, ts: str = "date", di: str = "di") -> DataFrame:
    """events plus di: the position of the first calendar day at or after ts; events after the last day go.

    Days in between meet their calendar day in a table of one row per day, which is small whatever the events' number.
    """
    days = p.select("date", di).distinct()
    asked = events.select(F.col(ts).alias("_day")).distinct().select(F.lit(1).alias("_all"), "_day")
    found = asof(asked, days.select(F.lit(1).alias("_all"), F.col("date").alias("_at"), di), ["_all"], "_day", "_at", [di], direction="forward")
    return events.join(found.where(f"{di} is not null").select(F.col("_day").alias(ts), di), ts)
