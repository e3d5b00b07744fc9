"""Windows along time: shifts, rolling and exponential statistics, state carry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def own(by: str = "ticker", order: str = "di"):
    return Window.partitionBy(by).orderBy(order)


def shift_calendar(p: DataFrame, value: str, k: int, name: str, by: str = "ticker") -> DataFrame:
    """p plus the value k calendar positions earlier (later for k < 0); null where that day has no row. One row a key and day."""
    there = Window.partitionBy(by).orderBy("di").rangeBetween(-k, -k)
    return p.withColumn(name, F.max(value).over(there))


def shift_own(value: str, k: int, by: str = "ticker", order: str = "di") -> Column:
    """The value k rows earlier (later for k < 0) among a key's own rows."""
    return F.lag(value, k).over(own(by, order)) if k >= 0 else F.lead(value, -k).over(own(by, order))


def rolling(f, value: str, n: int, least: int | None = None, by: str = "ticker", order: str = "di") -> Column:
    """f over the last n rows; null with fewer than `least` values (n, if not given)."""
    w = own(by, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(w) >= (n if least is None else least), f(value).over(w))


def past(f, value: str, least: int, by: str = "ticker", order: str = "di", n: int | None = None) -> Column:
    """f over all rows before this one (the last n of them); null with fewer than `least` values."""
    w = own(by, order).rowsBetween(Window.unboundedPreceding if n is None else -n, -1)
    return F.when(F.count(value).over(w) >= least, f(value).over(w))


def ewm(value: str, span: float | None = None, alpha: float | None = None, by: str = "ticker", order: str = "di") -> Column:
    """with_ewm as a column, for short spans: each row reads its look-back, the rows whose weights show in a double.

    The sums carry what rounding cuts off, so means that are equal in real numbers don't hang on the order of the rows.
    """
    a = 2 / (span + 1) if alpha is None else alpha
    back = math.ceil(math.log(1e-17) / math.log(1 - a))
    w = own(by, order).rowsBetween(-(back - 1), 0)
    seen = F.collect_list(F.struct(F.coalesce(F.col(value), F.lit(float("nan"))).alias("x"))).over(w)
    n = F.size(seen)
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("s", "s_cut", "w", "w_cut")), F.lit(0).alias("i"))

    def carried(acc, c, x):
        total = acc[c] + x
        cut = F.when(F.abs(acc[c]) >= F.abs(x), (acc[c] - total) + x).otherwise((x - total) + acc[c])
        return total.alias(c), (acc[f"{c}_cut"] + cut).alias(f"{c}_cut")

    def add(acc, e):
        weight = F.pow(F.lit(1 - a), n - 1 - acc["i"])
        ok = ~F.isnan(e["x"])
        return F.struct(*carried(acc, "s", F.when(ok, weight * e["x"]).otherwise(0.0)), *carried(acc, "w", F.when(ok, weight).otherwise(0.0)), (acc["i"] + 1).alias("i"))

    return F.when(F.count(value).over(w) > 0, F.aggregate(seen, start, add, lambda acc: (acc["s"] + acc["s_cut"]) / (acc["w"] + acc["w_cut"])))


def with_ewm(p: DataFrame, name: str, value: str, span: float | None = None, alpha: float | None = None, by: str = "ticker", order: str = "di") -> DataFrame:
    """p plus the exponentially weighted mean of all values so far, weights by position (nulls keep theirs); null before the first.

    A key's rows are cut into blocks so long that weights a block back are under 1e-17 of the row's own. Within a block the
    weighted sums are running sums of values that grow by the row; the block before comes in by its last sums. So each row
    costs the same whatever the span. A row without a value has the mean of the last row with one.
    """
    a = 2 / (span + 1) if alpha is None else alpha
    keep = 1 - a
    block = max(1, math.ceil(math.log(1e-17) / math.log(keep))) if keep > 0 else 1
    w = own(by, order)
    t = {n: f"_ewm_{n}" for n in ("at", "block", "s", "w", "s0", "w0")}
    x = p.withColumn(t["at"], F.row_number().over(w) - 1)
    x = x.withColumns({t["block"]: F.floor(F.col(t["at"]) / block), t["at"]: F.col(t["at"]) % block})
    inside = Window.partitionBy(by, t["block"]).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grown = F.when(F.col(value).isNotNull(), F.pow(F.lit(keep), -F.col(t["at"]))).otherwise(0.0) if keep > 0 else F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)
    fade = F.pow(F.lit(keep), F.col(t["at"])) if keep > 0 else F.lit(1.0)
    x = x.withColumns({t["s"]: fade * F.sum(grown * F.coalesce(F.col(value), F.lit(0.0))).over(inside), t["w"]: fade * F.sum(grown).over(inside)})
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.coalesce(F.last(F.when(F.col(t["at"]) == block - 1, F.col(c)), ignorenulls=True).over(past), F.lit(0.0)) * F.pow(F.lit(keep), F.col(t["at"]) + 1)
    x = x.withColumns({t["s0"]: last(t["s"]), t["w0"]: last(t["w"])})
    mean = F.when(F.col(value).isNotNull(), (F.col(t["s"]) + F.col(t["s0"])) / (F.col(t["w"]) + F.col(t["w0"])))
    return x.withColumn(name, F.last(mean, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(*t.values())


def trailing_distinct(events: DataFrame, days: DataFrame, item: str, n: int, name: str, by: str = "ticker", order: str = "di") -> DataFrame:
    """days (one row a key and position) plus the number of distinct items of the last n positions, events' own position counted.

    An item heard at a position is alive until it is heard again or n positions on. Births add one, deaths take one, and a
    running sum over these marks is the count: no lists, and work linear in the events.
    """
    heard = events.where(F.col(item).isNotNull()).select(by, item, order).distinct()
    again = F.lead(order).over(Window.partitionBy(by, item).orderBy(order))
    end = F.least(F.coalesce(again, F.col(order) + n), F.col(order) + n)
    marks = heard.withColumn("_end", end).select(by, F.explode(F.array(F.struct(F.col(order), F.lit(1).alias("_n")), F.struct(F.col("_end").alias(order), F.lit(-1).alias("_n")))).alias("_m"))
    marks = marks.groupBy(by, F.col(f"_m.{order}").alias(order)).agg(F.sum("_m._n").alias("_n"))
    row = F.struct(*days.columns)
    both = days.select(by, order, F.lit(0).cast("long").alias("_n"), row.alias("_row")).unionByName(marks, allowMissingColumns=True)
    alive = F.sum("_n").over(own(by, order).rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn(name, alive).where("_row is not null").select("_row.*", name)


def hysteresis(pct: str, enter: float, leave: float, by: str = "ticker", order: str = "di") -> Column:
    """Whether a name is held: in at pct >= 1 - enter, out under 1 - leave or null, as before in between."""
    decisive = F.when(F.col(pct) >= 1 - enter, 1).when(F.col(pct) >= 1 - leave, None).otherwise(0)
    return F.coalesce(F.last(decisive, ignorenulls=True).over(own(by, order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) == 1
