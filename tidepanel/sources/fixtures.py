"""Panels, events and streams over the driver tables, each as a DataFrame and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, open, high, low, close, volume): a nation's weekly unit prices; keyed by (date, ticker)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return lines.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("s_nationkey").alias("ticker")).agg(
        F.min_by(unit, order).alias("open"), F.max(unit).alias("high"), F.min(unit).alias("low"),
        (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def numbered(p: DataFrame) -> DataFrame:
    """p with di, the position of its date among all dates. The window runs over distinct dates alone."""
    cal = p.select("date").distinct().withColumn("di", F.row_number().over(Window.orderBy("date")))
    return p.join(cal, "date")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, period, sb, b, h, s, ss): monthly counts of the five order priorities per nation."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return o.groupBy(F.col("c_nationkey").alias("ticker"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("period")).agg(
        *(F.count_if(F.col("o_orderpriority") == n).alias(c) for n, c in zip(names, ("sb", "b", "h", "s", "ss"), strict=True))
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, actual, estimate): quarterly mean order price; the estimate is the quarter before's."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    q = o.groupBy(F.col("c_nationkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q")).agg(F.avg("o_totalprice").alias("actual"))
    before = F.lag("actual").over(Window.partitionBy("ticker").orderBy("q"))
    return q.select("ticker", F.date_add(F.add_months("q", 3), 29).alias("date"), "actual", before.alias("estimate"))


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, company, ts, action): rating actions made of orders."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    action = F.when(F.col("o_orderstatus") == "F", "up").when(F.col("o_orderstatus") == "O", "down").otherwise("init")
    return o.select(F.col("c_nationkey").alias("ticker"), (F.col("o_custkey") % 40).alias("company"), F.to_date("o_orderdate").alias("date"), action.alias("action"), "o_orderkey")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, date, value): each user's daily sum of events."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("user"), F.to_date("ts").alias("date")).agg(F.sum("value").alias("value"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, response): the last event of a day as a class in a text; some without a tag, with one in lower case, or a foreign one behind."""
    e = table(spark, sf_dir, "events").withColumn("ticker", F.col("user_id") % 25).withColumn("date", F.to_date("ts"))
    last = e.groupBy("ticker", "date").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
    name = F.element_at(F.create_map(*(F.lit(x) for pair in CLASS_OF.items() for x in pair)), F.col("kind"))
    k = F.col("event_id") % 12
    tag = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit(" [[[ "), F.lower(name), F.lit(" ]]]"))).when(k == 2, F.concat(F.lit(" [[["), name, F.lit("]]] or [[[MAYBE]]]"))).otherwise(F.concat(F.lit(" [[["), name, F.lit("]]]")))
    return last.select("ticker", "date", F.concat(F.lit("I read "), "kind", tag).alias("response"))


#: The classes that event types stand for.
CLASS_OF = {"click": "BUY", "purchase": "STRONG_BUY", "view": "HOLD", "signup": "SELL", "error": "STRONG_SELL"}

#: The same in SQL; each entry names what it needs.
_SQL = {
    "panel": ((), "SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, s_nationkey AS ticker, arg_min(l_extendedprice / l_quantity, l_shipdate) AS open0, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"),
    "cal": (("panel",), "SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM panel)"),
    "p": (("cal",), "SELECT panel.*, di FROM panel JOIN cal USING (date)"),
    "recs": ((), "SELECT c_nationkey AS ticker, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, " + ", ".join(f"sum(CASE WHEN o_orderpriority = '{n}' THEN 1 ELSE 0 END) AS {c}" for n, c in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), ("sb", "b", "h", "s", "ss"), strict=True)) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    "earn": ((), "SELECT ticker, CAST(q + INTERVAL 3 MONTH + INTERVAL 29 DAY AS DATE) AS date, actual, lag(actual) OVER (PARTITION BY ticker ORDER BY q) AS estimate FROM (SELECT c_nationkey AS ticker, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, avg(o_totalprice) AS actual FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"),
    "grades": ((), "SELECT c_nationkey AS ticker, o_custkey % 40 AS company, CAST(o_orderdate AS DATE) AS date, CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' ELSE 'init' END AS action, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"),
    "daily": ((), "SELECT user_id AS \"user\", CAST(ts AS DATE) AS date, sum(value) AS value FROM events GROUP BY 1, 2"),
    "mom": (("p",), "SELECT p.date, p.di, p.ticker, p.close / b.close - 1 AS value FROM p JOIN p b ON p.ticker = b.ticker AND b.di = p.di - 10"),
    "fwd": (("p",), "SELECT p.date, p.di, p.ticker, b.close / p.close - 1 AS fwd FROM p JOIN p b ON p.ticker = b.ticker AND b.di = p.di + 1"),
    "legs": (("mom",), "SELECT mom.*, value >= q80 AS up, value <= q20 AS down FROM mom JOIN (SELECT di, quantile_cont(value, 0.8) AS q80, quantile_cont(value, 0.2) AS q20 FROM mom GROUP BY di) USING (di)"),
    "ls": (("legs", "fwd"), "SELECT legs.date, legs.di, avg(CASE WHEN up THEN fwd END) - avg(CASE WHEN down THEN fwd END) AS r FROM legs JOIN fwd USING (di, ticker) GROUP BY 1, 2 HAVING avg(CASE WHEN up THEN fwd END) IS NOT NULL AND avg(CASE WHEN down THEN fwd END) IS NOT NULL"),
    "mom1": (("p",), "SELECT p.date, p.di, p.ticker, p.close / b.close - 1 AS value FROM p JOIN p b ON p.ticker = b.ticker AND b.di = p.di - 1"),
    "mom5": (("p",), "SELECT p.date, p.di, p.ticker, p.close / b.close - 1 AS value FROM p JOIN p b ON p.ticker = b.ticker AND b.di = p.di - 5"),
    "mom21": (("p",), "SELECT p.date, p.di, p.ticker, p.close / b.close - 1 AS value FROM p JOIN p b ON p.ticker = b.ticker AND b.di = p.di - 21"),
    "ema": (("p",), "SELECT a.date, a.di, a.ticker, sum(b.close * pow(0.5, a.rn - b.rn)) / sum(pow(0.5, a.rn - b.rn)) AS ema FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY di) AS rn FROM p) a JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY di) AS rn FROM p) b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY 1, 2, 3"),
    "sig": (("ema",), "SELECT date, di, ticker, 0.3 * r3 / v3 + 0.5 * r7 / v7 + 0.2 * r15 / v15 AS signal FROM (SELECT *, " + ", ".join(f"CASE WHEN count(r{h}) OVER w = 20 THEN nullif(stddev_samp(r{h}) OVER w, 0) END AS v{h}" for h in (3, 7, 15)) + " FROM (SELECT *, " + ", ".join(f"lead(ema, {h}) OVER v / ema - 1 AS r{h}" for h in (3, 7, 15)) + " FROM ema WINDOW v AS (PARTITION BY ticker ORDER BY di)) WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"),
    "lab": (("sig",), "SELECT date, di, ticker, signal, CASE WHEN signal >= q[4] THEN 'STRONG_BUY' WHEN signal >= q[3] THEN 'BUY' WHEN signal >= q[2] THEN 'HOLD' WHEN signal >= q[1] THEN 'SELL' ELSE 'STRONG_SELL' END AS cls FROM sig JOIN (SELECT ticker, quantile_cont(signal, [0.03, 0.15, 0.53, 0.85]) AS q FROM sig WHERE signal IS NOT NULL GROUP BY ticker) USING (ticker) WHERE signal IS NOT NULL"),
    "pead": (("p", "earn"), "SELECT p.date, p.di, p.ticker, CASE WHEN date_diff('day', e.date, p.date) <= 90 THEN (e.actual - e.estimate) / abs(e.estimate) END AS value FROM p ASOF LEFT JOIN (SELECT * FROM earn WHERE estimate IS NOT NULL AND estimate <> 0) e ON p.ticker = e.ticker AND p.date >= e.date"),
    "quint": (("legs",), "SELECT date, di, ticker, (CASE WHEN up THEN 0.5 / sum(up::INT) OVER v ELSE 0 END) - (CASE WHEN down THEN 0.5 / sum(down::INT) OVER v ELSE 0 END) AS weight FROM legs WINDOW v AS (PARTITION BY di)"),
    "edges": (("grades",), "SELECT a.y, a.ticker AS src, b.ticker AS dst, sum(1.0 / n) AS w FROM (SELECT DISTINCT year(date) + k AS y, ticker, company FROM grades, (VALUES (1), (2)) t(k)) a JOIN (SELECT DISTINCT year(date) + k AS y, ticker, company FROM grades, (VALUES (1), (2)) t(k)) b ON a.y = b.y AND a.company = b.company AND a.ticker <> b.ticker JOIN (SELECT y, company, count(*) AS n FROM (SELECT DISTINCT year(date) + k AS y, ticker, company FROM grades, (VALUES (1), (2)) t(k)) GROUP BY 1, 2) s ON s.y = a.y AND s.company = a.company GROUP BY 1, 2, 3"),
    "own": (("p",), "SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY di) - 1 AS r FROM p"),
}


def with_sql(names: str, query: str) -> str:
    """query after a WITH of the named fixtures and all they need."""
    order: list[str] = []

    def need(n):
        for m in _SQL[n][0]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        need(n)
    return "WITH " + ", ".join(f"{n} AS ({_SQL[n][1]})" for n in order) + ("" if query.startswith(",") else " ") + query
