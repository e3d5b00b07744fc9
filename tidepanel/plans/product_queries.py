"""Queries over the panel: labels, signals, graphs, portfolios, backtests, event studies and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import metrics as M
from tidepanel.operators import asof as A
from tidepanel.operators import pairs as PR
from tidepanel.operators import risk as R
from tidepanel.operators import windows as W
from tidepanel.operators import xsection as X
from tidepanel.sources import fixtures as S

from .panel_queries import OWN, P, cocoverage, daily_ic, forward, ls_returns, momentum, one, pooled_ic, query, quintile_weights, r6, turnover

HORIZONS = ((3, 0.3), (7, 0.5), (15, 0.2))
CLASSES = ("STRONG_SELL", "SELL", "HOLD", "BUY", "STRONG_BUY")
RANK = "rank() OVER (PARTITION BY di ORDER BY {0}) + (count(*) OVER (PARTITION BY di, {0}) - 1) / 2.0"


# ------------------------------------------------------------------- labels


def signal(p: DataFrame) -> DataFrame:
    """(date, di, ticker, signal): smoothed forward returns over their own rolling deviation, blended; null if one is missing."""
    e = W.with_ewm(p.select("date", "di", "ticker", "close"), "ema", "close", span=3).drop("close")
    for h, _ in HORIZONS:
        e = e.withColumn(f"r{h}", W.shift_own("ema", -h) / F.col("ema") - 1)
    parts = (F.lit(w) * F.col(f"r{h}") / F.nullif(W.rolling(F.stddev_samp, f"r{h}", 20), F.lit(0.0)) for h, w in HORIZONS)
    return e.select("date", "di", "ticker", reduce(lambda a, b: a + b, parts).alias("signal"))


def classes(s: DataFrame, cuts=(0.03, 0.15, 0.53, 0.85)) -> DataFrame:
    """The rows of s with a signal, plus cls: five classes by the ticker's own quantiles, borders in the upper class."""
    q = F.percentile("signal", F.array(*map(F.lit, cuts))).over(Window.partitionBy("ticker"))
    name = F.lit(CLASSES[0])
    for k, c in enumerate(CLASSES[1:]):
        name = F.when(F.col("signal") >= F.col("_q")[k], c).otherwise(name)
    return s.where("signal is not null").withColumn("_q", q).withColumn("cls", name).drop("_q")


@query("SELECT di, ticker, round(signal, 6) AS signal FROM sig", "sig")
def lbl_01(spark, d):
    return signal(P(spark, d)).select("di", "ticker", *r6("signal"))


@query("SELECT di, ticker, cls FROM lab", "lab")
def lbl_02_signal(spark, d):
    return classes(signal(P(spark, d))).select("di", "ticker", "cls")


@query("SELECT di, ticker, h, round((rank() OVER (PARTITION BY di, h ORDER BY f) + (count(*) OVER (PARTITION BY di, h, f) - 1) / 2.0) / count(*) OVER (PARTITION BY di, h), 6) AS pct FROM (SELECT p.di, p.ticker, h, b.close / p.close - 1 AS f FROM p, (VALUES (3), (7), (15)) t(h), p b WHERE b.ticker = p.ticker AND b.di = p.di + h)")
def lbl_03(spark, d):
    p = P(spark, d).select("di", "ticker", "close")
    for h in (3, 7, 15):
        p = W.shift_calendar(p, "close", -h, f"f{h}")
    f = p.select("di", "ticker", F.explode(F.array(*(F.struct(F.lit(h).alias("h"), (F.col(f"f{h}") / F.col("close") - 1).alias("f")) for h in (3, 7, 15)))).alias("x")).select("di", "ticker", "x.h", "x.f").where("f is not null")
    w = Window.partitionBy("di", "h")
    rank = F.rank().over(w.orderBy("f")) + (F.count("*").over(Window.partitionBy("di", "h", "f")) - 1) / 2
    return f.select("di", "ticker", "h", F.round(rank / F.count("*").over(w), 6).alias("pct"))


# ------------------------------------------------------------------ signals


def skipped_momentum(p: DataFrame, back: int = 252, skip: int = 21) -> DataFrame:
    """(date, di, ticker, value): the return over `back` positions that ended `skip` positions ago."""
    x = W.shift_calendar(W.shift_calendar(p.select("date", "di", "ticker", "close"), "close", skip, "to"), "close", skip + back, "start")
    return x.where("to is not null and start is not null").select("date", "di", "ticker", (F.col("to") / F.col("start") - 1).alias("value"))


LONG = "(SELECT p.date, p.di, p.ticker, a.close / b.close - 1 AS value FROM p JOIN p a ON a.ticker = p.ticker AND a.di = p.di - 21 JOIN p b ON b.ticker = p.ticker AND b.di = p.di - 273)"


@query(f"SELECT di, ticker, round(value, 6) AS value FROM {LONG}")
def sig_02(spark, d):
    return skipped_momentum(P(spark, d)).select("di", "ticker", *r6("value"))


def consensus(spark, d) -> DataFrame:
    return S.recommendations(spark, d).select("ticker", "period", F.expr("(2 * sb + b - s - 2 * ss) / nullif(sb + b + h + s + ss, 0)").alias("score"))


SCORE = "(SELECT ticker, period, (2 * sb + b - s - 2 * ss) / nullif(sb + b + h + s + ss, 0)::DOUBLE AS score FROM recs)"


@query(f"SELECT x.di, x.ticker, round(x.score - y.score, 6) AS revision FROM (SELECT p.di, p.ticker, score FROM p ASOF LEFT JOIN {SCORE} s ON p.ticker = s.ticker AND p.date >= s.period) x LEFT JOIN (SELECT p.di, p.ticker, score FROM p ASOF LEFT JOIN {SCORE} s ON p.ticker = s.ticker AND p.date >= s.period) y ON y.ticker = x.ticker AND y.di = x.di - 63", "p recs")
def sig_03(spark, d):
    x = A.asof(P(spark, d).select("date", "di", "ticker"), consensus(spark, d), ["ticker"], "date", "period", ["score"])
    return W.shift_calendar(x, "score", 63, "before").select("di", "ticker", F.round(F.col("score") - F.col("before"), 6).alias("revision"))


@query(f"SELECT ticker, date, round(max(CASE WHEN k = 1 THEN score END), 6) AS level, round(CASE WHEN count(*) >= 4 THEN max(CASE WHEN k = 1 THEN score END) - max(CASE WHEN k = 4 THEN score END) END, 6) AS revision FROM (SELECT e.ticker, e.date, s.score, row_number() OVER (PARTITION BY e.ticker, e.date ORDER BY s.period DESC) AS k FROM earn e JOIN {SCORE} s ON s.ticker = e.ticker AND s.period <= e.date) GROUP BY 1, 2", "earn recs")
def sig_04(spark, d):
    w = Window.partitionBy("ticker").orderBy("period")
    s = consensus(spark, d).select("ticker", "period", "score", F.lag("score", 3).over(w).alias("fourth"), (F.row_number().over(w) >= 4).alias("enough"))
    got = A.asof(S.earnings(spark, d).select("ticker", "date"), s, ["ticker"], "date", "period", ["score", "fourth", "enough"]).where("matched is not null")
    return got.select("ticker", "date", F.round("score", 6).alias("level"), F.round(F.when(F.col("enough"), F.col("score") - F.col("fourth")), 6).alias("revision"))


def surprise(spark, d, p: DataFrame) -> DataFrame:
    e = S.earnings(spark, d).where("estimate is not null and estimate <> 0").withColumn("value", F.expr("(actual - estimate) / abs(estimate)"))
    return A.asof(p.select("date", "di", "ticker"), e, ["ticker"], "date", "date", ["value"], tolerance_days=90)


def mean_of(*names: str) -> Column:
    """The mean of the values that are there; null if none is."""
    there = reduce(lambda a, b: a + b, (F.col(n).isNotNull().cast("int") for n in names))
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(n), F.lit(0.0)) for n in names)) / F.nullif(there, F.lit(0))


RANKS = f"(SELECT p.di, p.ticker, m.rk AS a, e.rk AS b FROM p LEFT JOIN (SELECT di, ticker, ({RANK.format('value')}) / count(*) OVER (PARTITION BY di) AS rk FROM mom) m USING (di, ticker) LEFT JOIN (SELECT di, ticker, ({RANK.format('value')}) / count(*) OVER (PARTITION BY di) AS rk FROM pead WHERE value IS NOT NULL) e USING (di, ticker))"
COMBO = f"(SELECT di, ticker, (coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0) AS value FROM {RANKS})"


def combo(spark, d, p: DataFrame) -> DataFrame:
    """(di, ticker, value): the mean of the ranks by momentum and by surprise that are there."""
    x = W.shift_calendar(p.select("date", "di", "ticker", "close"), "close", 10, "b").withColumn("m", F.col("close") / F.col("b") - 1)
    x = x.join(surprise(spark, d, p).select("di", "ticker", F.col("value").alias("e")), ["di", "ticker"], "left")
    x = x.select("di", "ticker", X.pct_rank("m").alias("a"), X.pct_rank("e").alias("b"))
    return x.select("di", "ticker", mean_of("a", "b").alias("value"))


@query(f"SELECT di, ticker, round(value, 6) AS value FROM {COMBO}", "p mom pead")
def sig_06(spark, d):
    return combo(spark, d, P(spark, d)).select("di", "ticker", *r6("value"))


@query(f"SELECT di, ticker, round(a, 6) AS a, round(b, 6) AS b, round((coalesce(a, 0) + coalesce(b, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT, 0), 6) AS mean FROM {RANKS}", "p mom pead")
def agg_02(spark, d):
    p = P(spark, d)
    x = W.shift_calendar(p.select("date", "di", "ticker", "close"), "close", 10, "b").withColumn("m", F.col("close") / F.col("b") - 1)
    x = x.join(surprise(spark, d, p).select("di", "ticker", F.col("value").alias("e")), ["di", "ticker"], "left")
    return x.select("di", "ticker", X.pct_rank("m").alias("a"), X.pct_rank("e").alias("b")).select("di", "ticker", *r6("a", "b"), F.round(mean_of("a", "b"), 6).alias("mean"))


EVENTS = "(SELECT grades.ticker, company, action, o_orderkey, min(cal.di) AS di FROM grades JOIN cal ON cal.date >= grades.date GROUP BY 1, 2, 3, 4)"


def breadth(g: DataFrame, p: DataFrame, win: int = 63, cov: int = 252) -> DataFrame:
    """(di, ticker, value): ups less downs of the last win days over the firms heard in the last cov days."""
    heard = A.on_calendar(g, p)
    e = heard.groupBy("ticker", "di").agg((F.count_if(F.col("action") == "up") - F.count_if(F.col("action") == "down")).alias("net"))
    x = p.select("di", "ticker", F.lit(True).alias("there")).join(e, ["di", "ticker"], "full")
    net = F.sum("net").over(Window.partitionBy("ticker").orderBy("di").rangeBetween(1 - win, 0))
    days = x.select("di", "ticker", "there", F.coalesce(net, F.lit(0)).alias("net")).where("there")
    return W.trailing_distinct(heard, days, "company", cov, "firms").select("di", "ticker", (F.col("net") / F.nullif("firms", F.lit(0))).alias("value"))


@query(f"SELECT p.di, p.ticker, round((count(e.di) FILTER (e.action = 'up' AND e.di > p.di - 63) - count(e.di) FILTER (e.action = 'down' AND e.di > p.di - 63)) / nullif(count(DISTINCT e.company), 0)::DOUBLE, 6) AS value FROM p LEFT JOIN {EVENTS} e ON e.ticker = p.ticker AND e.di BETWEEN p.di - 251 AND p.di GROUP BY 1, 2", "p grades")
def sig_07(spark, d):
    return breadth(S.grades(spark, d), P(spark, d)).select("di", "ticker", *r6("value"))


def links(spark, d) -> DataFrame:
    """(src, dst): nations that trade with each other, both ways."""
    t = lambda n: S.table(spark, d, n)
    x = t("lineitem").select("l_orderkey", "l_suppkey").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    one_way = x.select(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).where("src <> dst").distinct()
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


@query("SELECT DISTINCT src, dst FROM (SELECT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey UNION ALL SELECT c_nationkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE src <> dst", "")
def sig_09(spark, d):
    return links(spark, d)


def neighbours(edges: DataFrame, s: DataFrame) -> DataFrame:
    """(di, ticker, value): the weighted mean of the linked names' values with the graph of the day's year."""
    year = F.year("date").cast("long").alias("y")
    return s.select(year, "di", F.col("ticker").alias("src"), "value").join(edges, ["y", "src"]).groupBy("di", F.col("dst").alias("ticker")).agg((F.sum(F.col("w") * F.col("value")) / F.nullif(F.sum(F.when(F.col("value").isNotNull(), F.col("w"))), F.lit(0.0))).alias("value"))


_NEAR = "SELECT {k} AS k, m.di, e.dst AS ticker, round(sum(e.w * m.value) / sum(e.w), 6) AS value FROM {m} m JOIN {e} e ON e.y = year(m.date) AND e.src = m.ticker GROUP BY 1, 2, 3"


@query(" UNION ALL ".join(_NEAR.format(k=k, m=m, e="edges") for k, m in ((5, "mom5"), (10, "mom"), (21, "mom21"))), "edges mom mom5 mom21")
def sig_10(spark, d):
    p, e = P(spark, d), cocoverage(S.grades(spark, d))
    return reduce(DataFrame.unionByName, (neighbours(e, momentum(p, k)).select(F.lit(k).alias("k"), "di", "ticker", *r6("value")) for k in (5, 10, 21)))


@query("SELECT m.di, m.ticker, round(sum(e.w * s.value) / sum(e.w), 6) AS value FROM mom m JOIN edges e ON e.y = year(m.date) AND e.dst = m.ticker JOIN mom s ON s.di = m.di AND s.ticker = e.src GROUP BY 1, 2", "edges mom")
def jn_11(spark, d):
    m, e = momentum(P(spark, d)), cocoverage(S.grades(spark, d))
    return neighbours(e, m).join(m.select("di", "ticker"), ["di", "ticker"], "left_semi").select("di", "ticker", *r6("value"))


COVER = "(SELECT y, ticker, CASE WHEN rn <= floor((n + 1) / 3.0) THEN 0 WHEN rn > n - ceil(n / 3.0) THEN 2 ELSE 1 END AS third FROM (SELECT y, ticker, row_number() OVER (PARTITION BY y ORDER BY c, ticker) AS rn, count(*) OVER (PARTITION BY y) AS n FROM (SELECT y, src AS ticker, count(*) AS c FROM edges GROUP BY 1, 2)))"


def coverage_thirds(edges: DataFrame) -> DataFrame:
    """(y, ticker, third): thirds of names by their number of links in a year."""
    c = edges.groupBy("y", F.col("src").alias("ticker")).agg(F.count("*").alias("c"))
    return c.select("y", "ticker", X.terciles("c", by="y").alias("third"))


@query(_NEAR.format(k=10, m="mom", e=f"(SELECT e.* FROM edges e JOIN {COVER} c ON c.y = e.y AND c.ticker = e.src WHERE c.third = 2)"), "edges mom")
def sig_11(spark, d):
    e = cocoverage(S.grades(spark, d))
    top = coverage_thirds(e).where("third = 2").select("y", F.col("ticker").alias("src"))
    return neighbours(e.join(top, ["y", "src"]), momentum(P(spark, d))).select(F.lit(10).alias("k"), "di", "ticker", *r6("value"))


@query(f"SELECT y, count(*) AS links, count(DISTINCT src) AS names, round(count(*) / count(DISTINCT src)::DOUBLE, 6) AS degree, round(count(*) / (count(DISTINCT src) * (count(DISTINCT src) - 1))::DOUBLE, 6) AS density, (SELECT count(DISTINCT ticker) FROM grades) - count(DISTINCT src) AS isolated, round(count(*) FILTER (third = 0) / nullif(count(DISTINCT src) FILTER (third = 0), 0)::DOUBLE, 6) AS bottom_degree, round(count(*) FILTER (third = 0) / nullif(count(DISTINCT src) FILTER (third = 0) * (count(DISTINCT src) - 1), 0)::DOUBLE, 6) AS bottom_density FROM edges JOIN {COVER} c USING (y) WHERE c.ticker = src GROUP BY y", "edges")
def sig_12(spark, d):
    """The size of each year's graph, and how many links the third of names with the fewest has."""
    g = S.grades(spark, d)
    e = cocoverage(g)
    low = coverage_thirds(e).where("third = 0").select("y", F.col("ticker").alias("src"), F.lit(1).alias("low"))
    at = F.col("low") == 1
    e = e.join(low, ["y", "src"], "left").groupBy("y").agg(F.count("*").alias("links"), F.count_distinct("src").alias("names"), F.count_if(at).alias("low_links"), F.count_distinct(F.when(at, F.col("src"))).alias("low_names"))
    n = g.agg(F.count_distinct("ticker").alias("all"))
    x = e.crossJoin(F.broadcast(n))  # one row
    degree = F.col("low_links") / F.nullif("low_names", F.lit(0))
    return x.select("y", "links", "names", F.round(F.col("links") / F.col("names"), 6).alias("degree"), F.round(F.col("links") / (F.col("names") * (F.col("names") - 1)), 6).alias("density"), (F.col("all") - F.col("names")).alias("isolated"), F.round(degree, 6).alias("bottom_degree"), F.round(degree / F.nullif(F.col("names") - 1, F.lit(0)), 6).alias("bottom_density"))


@query("""SELECT di, ticker, round((s - CASE WHEN lead3 THEN r ELSE 0 END) / (k - lead3::INT), 6) AS value FROM (
    SELECT *, sum(CASE WHEN lead3 THEN r END) OVER (PARTITION BY di, ind) AS s, sum(lead3::INT) OVER (PARTITION BY di, ind) AS k FROM (
        SELECT *, row_number() OVER (PARTITION BY di, ind ORDER BY dv DESC, ticker) <= 3 AS lead3, count(*) OVER (PARTITION BY di, ind) AS n FROM (
            SELECT o.di, o.ticker, n_regionkey AS ind, m.value AS r, CASE WHEN count(dv0) OVER w >= 40 THEN avg(dv0) OVER w END AS dv FROM (SELECT *, close * volume AS dv0 FROM p) o JOIN nation ON n_nationkey = o.ticker LEFT JOIN mom5 m ON m.di = o.di AND m.ticker = o.ticker WINDOW w AS (PARTITION BY o.ticker ORDER BY o.di ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)
        ) WHERE dv IS NOT NULL AND r IS NOT NULL) WHERE n >= 5) WHERE k - lead3::INT >= 2""", "p mom5")
def sig_13(spark, d):
    p = P(spark, d).withColumn("dv0", F.col("close") * F.col("volume"))
    x = W.shift_calendar(p, "close", 5, "b").withColumn("dv", W.rolling(F.avg, "dv0", 63, 40)).withColumn("r", F.col("close") / F.col("b") - 1)
    names = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("ticker"), F.col("n_regionkey").alias("ind"))
    x = x.join(names, "ticker").where("dv is not null and r is not null")
    w = Window.partitionBy("di", "ind")
    x = x.withColumn("lead", (F.row_number().over(w.orderBy(F.desc("dv"), "ticker")) <= 3).cast("int")).withColumn("n", F.count("*").over(w)).where("n >= 5")
    x = x.withColumn("s", F.sum(F.col("lead") * F.col("r")).over(w)).withColumn("k", F.sum("lead").over(w)).where("k - lead >= 2")
    return x.select("di", "ticker", F.round((F.col("s") - F.col("lead") * F.col("r")) / (F.col("k") - F.col("lead")), 6).alias("value"))


def three(p: DataFrame) -> DataFrame:
    """(di, ticker, y, x1, x2): returns over 10, 21 and 5 positions, where all are there."""
    x = p.select("di", "ticker", "close")
    for n, k in (("y", 10), ("x1", 21), ("x2", 5)):
        x = W.shift_calendar(x, "close", k, "b").withColumn(n, F.col("close") / F.col("b") - 1).drop("b")
    return x.where("y is not null and x1 is not null and x2 is not null")


_THREE = "(SELECT m.di, m.ticker, m.value AS y, l.value AS x1, s.value AS x2 FROM mom m JOIN mom21 l USING (di, ticker) JOIN mom5 s USING (di, ticker))"


@query(f"SELECT di, ticker, round(zy - sum(zx * zy) OVER w / nullif(sum(zx * zx) OVER w, 0) * zx, 6) AS residual FROM (SELECT di, ticker, (ry - avg(ry) OVER v) / nullif(stddev_samp(ry) OVER v, 0) AS zy, (rx - avg(rx) OVER v) / nullif(stddev_samp(rx) OVER v, 0) AS zx FROM (SELECT di, ticker, {RANK.format('y')} AS ry, {RANK.format('x1')} AS rx FROM {_THREE}) WINDOW v AS (PARTITION BY di)) WINDOW w AS (PARTITION BY di)", "mom mom21 mom5")
def sig_14(spark, d):
    return X.residual_rank(three(P(spark, d)), "y", "x1").select("di", "ticker", *r6("residual"))


@query(f"SELECT di, ticker, round(y - (s1y * s22 - s2y * s12) / det * a - (s2y * s11 - s1y * s12) / det * b, 6) AS residual FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (SELECT di, ticker, y, a, b, n, sum(a * a) OVER w AS s11, sum(b * b) OVER w AS s22, sum(a * b) OVER w AS s12, sum(a * y) OVER w AS s1y, sum(b * y) OVER w AS s2y FROM (SELECT di, ticker, y - avg(y) OVER v AS y, x1 - avg(x1) OVER v AS a, x2 - avg(x2) OVER v AS b, count(*) OVER v AS n FROM {_THREE} WINDOW v AS (PARTITION BY di)) WINDOW w AS (PARTITION BY di)) WHERE n >= 20)", "mom mom21 mom5")
def sig_15(spark, d):
    return X.residual_ols(three(P(spark, d)), "y", "x1", "x2", 20).where("residual is not null").select("di", "ticker", *r6("residual"))


# --------------------------------------------------------------- portfolios


def gross_one(value: Column, by: str = "di") -> Column:
    """value over the day's sum of absolute values; 0 where that sum is 0 or the value is missing."""
    return F.coalesce(value / F.nullif(F.sum(F.abs(value)).over(Window.partitionBy(by)), F.lit(0.0)), F.lit(0.0))


@query("SELECT di, ticker, round(coalesce(value / nullif(sum(abs(value)) OVER (PARTITION BY di), 0), 0), 6) AS weight FROM mom", "mom")
def agg_14(spark, d):
    return momentum(P(spark, d)).select("di", "ticker", F.round(gross_one(F.col("value")), 6).alias("weight"))


@query(f"SELECT di, ticker, round(1.0 / count(*) OVER (PARTITION BY di), 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY di ORDER BY value DESC, ticker) AS k FROM {LONG}) WHERE k <= 5")
def pf_02(spark, d):
    w = Window.partitionBy("di")
    top = skipped_momentum(P(spark, d)).withColumn("k", F.row_number().over(w.orderBy(F.desc("value"), "ticker"))).where("k <= 5")
    return top.select("di", "ticker", F.round(1.0 / F.count("*").over(w), 6).alias("weight"))


#: Sizing schemes by name: expressions of a score s, its deviation v and the ranks from both ends, before scaling to gross one.
SCHEMES = {
    "fixed": lambda: F.col("s"),
    "fixed_lo": lambda: F.greatest(F.col("s"), F.lit(0.0)),
    "inv_vol": lambda: F.col("s") / F.col("v"),
    "inv_vol_lo": lambda: F.greatest(F.col("s"), F.lit(0.0)) / F.col("v"),
    "rank": lambda: F.when((F.col("n") >= 6) & (F.col("high") <= 3), 1.0).when((F.col("n") >= 6) & (F.col("low") <= 3), -1.0).otherwise(0.0),
}
#: Scores of the classes.
BETS = {"STRONG_SELL": -2, "SELL": -1, "HOLD": 0, "BUY": 1, "STRONG_BUY": 2}
_BET = "CASE cls " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BETS.items()) + " END"
_VOL = "(SELECT di, ticker, CASE WHEN count(r) OVER w >= 20 THEN nullif(stddev_samp(r) OVER w, 0) END AS v FROM own WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))"
_SCORED = f"(SELECT l.di, l.ticker, ({_BET})::DOUBLE AS s, v.v, count(*) OVER (PARTITION BY l.di) AS n, row_number() OVER (PARTITION BY l.di ORDER BY {_BET} DESC, l.ticker) AS high, row_number() OVER (PARTITION BY l.di ORDER BY {_BET}, l.ticker DESC) AS low FROM lab l JOIN {_VOL} v USING (di, ticker))"
_RAW = {"fixed": "s", "fixed_lo": "greatest(s, 0)", "inv_vol": "s / v", "inv_vol_lo": "greatest(s, 0) / v", "rank": "CASE WHEN n >= 6 AND high <= 3 THEN 1.0 WHEN n >= 6 AND low <= 3 THEN -1.0 ELSE 0 END"}
SIZED = " UNION ALL ".join([f"SELECT '{k}' AS scheme, di, ticker, coalesce(({e}) / nullif(sum(abs({e})) OVER (PARTITION BY di), 0), 0) AS weight FROM {_SCORED}" for k, e in _RAW.items()] + [f"SELECT 'market', di, ticker, 1.0 / n FROM {_SCORED}", f"SELECT 'current', di, ticker, CASE WHEN s >= 1 AND high <= 8 THEN 0.125 ELSE 0 END FROM {_SCORED}"])


def sized(scored: DataFrame) -> DataFrame:
    """(scheme, di, ticker, weight) of scores (di, ticker, s, v) under every scheme."""
    w = Window.partitionBy("di")
    x = scored.withColumns({"n": F.count("*").over(w), "high": F.row_number().over(w.orderBy(F.desc("s"), "ticker")), "low": F.row_number().over(w.orderBy("s", F.desc("ticker")))})
    x = x.withColumns({f"w_{k}": gross_one(f()) for k, f in SCHEMES.items()} | {"w_market": 1.0 / F.col("n"), "w_current": F.when((F.col("s") >= 1) & (F.col("high") <= 8), 0.125).otherwise(0.0)})
    return x.select("di", "ticker", F.explode(F.array(*(F.struct(F.lit(k).alias("scheme"), F.col(f"w_{k}").alias("weight")) for k in (*SCHEMES, "market", "current")))).alias("z")).select("z.scheme", "di", "ticker", "z.weight")


def scored_labels(spark, d) -> DataFrame:
    p = P(spark, d)
    bet = F.element_at(F.create_map(*(F.lit(x) for kv in BETS.items() for x in kv)), F.col("cls")).cast("double")
    vol = p.withColumn("r", F.col("close") / W.shift_own("close", 1) - 1).select("di", "ticker", F.nullif(W.past(F.stddev_samp, "r", 20, n=60), F.lit(0.0)).alias("v"))
    return classes(signal(p)).select("di", "ticker", bet.alias("s")).join(vol, ["di", "ticker"])


@query(f"SELECT scheme, di, ticker, round(weight, 6) AS weight FROM ({SIZED})", "lab own")
def pf_04(spark, d):
    return sized(scored_labels(spark, d)).select("scheme", "di", "ticker", *r6("weight"))


@query(f"SELECT scheme, round(avg(r), 6) AS mean, count(*) AS days FROM (SELECT scheme, w.di, sum(weight * fwd) AS r FROM ({SIZED}) w JOIN fwd ON fwd.di = w.di AND fwd.ticker = w.ticker GROUP BY 1, 2) GROUP BY 1", "lab own fwd")
def bt_09(spark, d):
    w = sized(scored_labels(spark, d))
    return w.join(forward(P(spark, d)), ["di", "ticker"]).groupBy("scheme", "di").agg(F.sum(F.col("weight") * F.col("fwd")).alias("r")).groupBy("scheme").agg(F.round(F.avg("r"), 6).alias("mean"), F.count("*").alias("days"))


def banded(s: DataFrame, value: str = "value", enter: float = 0.2, leave: float = 0.35) -> DataFrame:
    """(di, ticker, weight): half a unit over the names held on each side, in at the outer band and out at the wider one."""
    x = s.withColumn("_p", X.pct_rank(value)).withColumn("_q", 1 - F.col("_p") + 1 / F.count(value).over(Window.partitionBy("di")))
    x = x.withColumn("up", W.hysteresis("_p", enter, leave)).withColumn("down", W.hysteresis("_q", enter, leave))
    part = lambda c: F.when(F.col(c), 0.5 / F.sum(F.col(c).cast("int")).over(Window.partitionBy("di"))).otherwise(0.0)
    return x.select("di", "ticker", (part("up") - part("down")).alias("weight"))


_STATE = "coalesce(last_value(CASE WHEN {0} >= 0.8 THEN 1 WHEN {0} >= 0.65 THEN NULL ELSE 0 END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
_BAND = f"SELECT di, ticker, up * 0.5 / greatest(sum(up) OVER (PARTITION BY di), 1) - down * 0.5 / greatest(sum(down) OVER (PARTITION BY di), 1) AS weight FROM (SELECT di, ticker, {_STATE.format('pct')} AS up, {_STATE.format('(1 - pct + 1.0 / n)')} AS down FROM (SELECT di, ticker, ({RANK.format('value')}) / count(*) OVER (PARTITION BY di) AS pct, count(*) OVER (PARTITION BY di) AS n FROM mom))"


@query(f"SELECT di, ticker, round(weight, 6) AS weight FROM ({_BAND})", "mom")
def pf_07(spark, d):
    return banded(momentum(P(spark, d))).select("di", "ticker", *r6("weight"))


def smoothed(s: DataFrame, span: float) -> DataFrame:
    """(di, ticker, value): the exponential mean over all calendar positions of the names' ranks, where there is a rank.

    Ranks tie often, so do their means; each is summed by itself, as sums carried over blocks of rows would part such ties.
    """
    ends = s.groupBy("ticker").agg(F.min("di").alias("lo"), F.max("di").alias("hi"))
    grid = ends.select("ticker", F.explode(F.sequence("lo", "hi")).alias("di"))
    x = grid.join(s.select("di", "ticker", X.pct_rank("value").alias("p")), ["di", "ticker"], "left")
    return x.withColumn("value", W.ewm("p", span=span)).where("p is not null").select("di", "ticker", "value")


_PCT = f"(SELECT di, ticker, ({RANK.format('value')}) / count(*) OVER (PARTITION BY di) AS pct FROM mom)"
_EMA = f"(SELECT {{0}} AS span, a.di, a.ticker, sum(b.pct * pow({{1}}, a.di - b.di)) / sum(pow({{1}}, a.di - b.di)) AS value FROM {_PCT} a JOIN {_PCT} b ON a.ticker = b.ticker AND b.di <= a.di GROUP BY 2, 3)"
_SMOOTH = " UNION ALL ".join(f"SELECT * FROM {_EMA.format(k, 1 - 2 / (k + 1))}" for k in (3, 5, 10))
_QUINTS = "(CASE WHEN value >= quantile_cont(value, 0.8) OVER v THEN 1 ELSE 0 END)", "(CASE WHEN value <= quantile_cont(value, 0.2) OVER v THEN 1 ELSE 0 END)"


@query(f", sm AS MATERIALIZED ({_SMOOTH}), qq AS (SELECT span, di, ticker, {_QUINTS[0]} AS up, {_QUINTS[1]} AS down FROM sm WINDOW v AS (PARTITION BY span, di)) SELECT 'ema' || span AS arm, di, ticker, round(up * 0.5 / greatest(sum(up) OVER w, 1) - down * 0.5 / greatest(sum(down) OVER w, 1), 6) AS weight FROM qq WINDOW w AS (PARTITION BY span, di) UNION ALL SELECT 'band+ema5', di, ticker, round(weight, 6) FROM ({_BAND.replace('FROM mom', 'FROM (SELECT * FROM sm WHERE span = 5)')})", "mom")
def pf_08(spark, d):
    """Weights from smoothed ranks: their outer fifths, and bands over their ranks."""
    m = momentum(P(spark, d))
    by = {s: smoothed(m, s) for s in (3, 5, 10)}
    arms = [quintile_weights(x).select(F.lit(f"ema{s}").alias("arm"), "di", "ticker", *r6("weight")) for s, x in by.items()]
    return reduce(DataFrame.unionByName, [*arms, banded(by[5]).select(F.lit("band+ema5").alias("arm"), "di", "ticker", *r6("weight"))])


def staggered(w: DataFrame, k: int = 4) -> DataFrame:
    """(di, ticker, weight): the mean of k books; book j takes over the weights of the days with di % k = j and holds them between."""
    held = [F.coalesce(F.last(F.when(F.col("di") % k == j, F.col("weight")), ignorenulls=True).over(Window.partitionBy("ticker").orderBy("di").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)) for j in range(k)]
    return w.select("di", "ticker", (reduce(lambda a, b: a + b, held) / k).alias("weight"))


@query("SELECT di, ticker, round((" + " + ".join(f"coalesce(last_value(CASE WHEN di % 4 = {j} THEN weight END IGNORE NULLS) OVER w, 0)" for j in range(4)) + ") / 4, 6) AS weight FROM quint WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "quint")
def pf_09(spark, d):
    return staggered(quintile_weights(momentum(P(spark, d))).select("di", "ticker", "weight")).select("di", "ticker", *r6("weight"))


# ---------------------------------------------------------------- backtests


def stream(w: DataFrame, p: DataFrame, lag: int = 0) -> DataFrame:
    """(di, r): each day's weights, `lag` days late, times the next return; a missing return is 0."""
    moved = w.select((F.col("di") + lag).alias("di"), "ticker", "weight")
    return moved.join(forward(p), ["di", "ticker"], "left").groupBy("di").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("r"))


_STREAM = "SELECT w.di + {0} AS di, sum(weight * coalesce(fwd, 0)) AS r FROM quint w LEFT JOIN fwd ON fwd.di = w.di + {0} AND fwd.ticker = w.ticker GROUP BY 1"


@query(f"SELECT di, round(r, 6) AS r FROM ({_STREAM.format(0)})", "quint fwd")
def bt_01(spark, d):
    p = P(spark, d)
    return stream(quintile_weights(momentum(p)), p).select("di", *r6("r"))


@query(f"SELECT di, round(r, 6) AS r FROM ({_STREAM.format(1)})", "quint fwd")
def bt_04(spark, d):
    p = P(spark, d)
    return stream(quintile_weights(momentum(p)), p, lag=1).select("di", *r6("r"))


_TURN = "x AS (SELECT w.di + 1 AS di, w.ticker, w.weight * (1 + coalesce(f.fwd, 0)) AS drift FROM quint w LEFT JOIN fwd f ON f.di = w.di AND f.ticker = w.ticker), g AS (SELECT di, CASE WHEN sum(abs(drift)) = 0 THEN 1 ELSE sum(abs(drift)) END AS gross FROM x GROUP BY di), y AS (SELECT x.di, x.ticker, x.drift / g.gross AS drift FROM x JOIN g USING (di)), t AS (SELECT di, 0.5 * sum(abs(coalesce(w.weight, 0) - coalesce(y.drift, 0))) AS turnover FROM quint w FULL JOIN y USING (di, ticker) GROUP BY di)"


@query(f"SELECT * FROM (WITH {_TURN} SELECT bps, s.di, round(s.r - t.turnover * bps / 10000.0 - 0.0035 * 0.5 / 252, 6) AS r FROM ({_STREAM.format(0)}) s JOIN t USING (di), (VALUES (5), (10), (20)) c(bps))", "quint fwd")
def bt_03(spark, d):
    p = P(spark, d)
    w = quintile_weights(momentum(p))
    net = stream(w, p).join(turnover(w, p), "di").withColumn("bps", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20))))
    return net.select("bps", "di", F.round(F.col("r") - F.col("turnover") * F.col("bps") / 10000.0 - 0.0035 * 0.5 / 252, 6).alias("r"))


_ARMS = f"SELECT * FROM (WITH {_TURN} SELECT bps, (s.r - t.turnover * bps / 10000.0) AS r FROM ({_STREAM.format(0)}) s JOIN t USING (di), (VALUES (5), (10), (20)) c(bps))"


@query(f"SELECT arg_max(bps, sharpe) AS best, round(max(sharpe), 6) AS sharpe FROM (SELECT bps, avg(r) / stddev_pop(r) * sqrt(252) AS sharpe FROM ({_ARMS}) GROUP BY bps)", "quint fwd")
def top_05(spark, d):
    p = P(spark, d)
    w = quintile_weights(momentum(p))
    arms = stream(w, p).join(turnover(w, p), "di").withColumn("bps", F.explode(F.array(F.lit(5), F.lit(10), F.lit(20)))).withColumn("r", F.col("r") - F.col("turnover") * F.col("bps") / 10000.0)
    s = arms.groupBy("bps").agg((F.avg("r") / F.stddev_pop("r") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    return s.agg(F.max_by("bps", "sharpe").alias("best"), F.round(F.max("sharpe"), 6).alias("sharpe"))


_HELD = "(SELECT o.di, o.ticker, o.r, CASE WHEN l.cls IN ('BUY', 'STRONG_BUY') THEN 1.0 ELSE 0.0 END AS held, CASE l.cls WHEN 'STRONG_BUY' THEN 2 WHEN 'BUY' THEN 1 ELSE 0 END AS strength FROM own o ASOF LEFT JOIN lab l ON l.ticker = o.ticker AND o.di > l.di)"


def held_names(spark, d) -> DataFrame:
    """(di, ticker, r, held, strength): each day's return, whether the class decided before the day says to hold the name, and how strongly."""
    p = P(spark, d)
    own = p.select("di", "ticker", (F.col("close") / W.shift_own("close", 1) - 1).alias("r"))
    told = classes(signal(p)).select("ticker", F.col("di").alias("told"), "cls")
    return A.asof(own, told, ["ticker"], "di", "told", ["cls"], inclusive=False).withColumns({"held": F.coalesce(F.col("cls").isin("BUY", "STRONG_BUY"), F.lit(False)).cast("double"), "strength": F.when(F.col("cls") == "STRONG_BUY", 2).when(F.col("cls") == "BUY", 1).otherwise(0)})


@query(f"SELECT ticker, round(sum(ln(1 + held * r)), 6) AS log_strategy, round(sum(ln(1 + r)), 6) AS log_hold, round(avg(held), 6) AS share FROM {_HELD} WHERE r IS NOT NULL GROUP BY 1", "own lab")
def bt_05(spark, d):
    x = held_names(spark, d).where("r is not null").groupBy("ticker")
    return x.agg(F.round(F.sum(F.log1p(F.col("held") * F.col("r"))), 6).alias("log_strategy"), F.round(F.sum(F.log1p("r")), 6).alias("log_hold"), F.round(F.avg("held"), 6).alias("share"))


@query(f"SELECT di, round(sum(held * coalesce(r, 0)) / 8, 6) AS r, sum(held)::BIGINT AS names FROM (SELECT *, row_number() OVER (PARTITION BY di ORDER BY strength DESC, ticker) AS k FROM {_HELD}) WHERE k <= 8 GROUP BY di", "own lab")
def bt_06(spark, d):
    """The stream of at most eight names held at an eighth each, the strongest decisions first, then in the order of names."""
    x = held_names(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("di").orderBy(F.desc("strength"), "ticker"))).where("k <= 8")
    return x.groupBy("di").agg(F.round(F.sum(F.col("held") * F.coalesce("r", F.lit(0.0))) / 8, 6).alias("r"), F.sum("held").cast("long").alias("names"))


@query("SELECT p.di, p.ticker, round(w.weight, 6) AS weight FROM p ASOF LEFT JOIN (SELECT * FROM quint WHERE di % 4 = 0) w ON w.ticker = p.ticker AND p.di > w.di", "p quint")
def win_15(spark, d):
    p = P(spark, d)
    w = quintile_weights(momentum(p)).where("di % 4 = 0").select("ticker", F.col("di").alias("at"), "weight")
    return A.asof(p.select("di", "ticker"), w, ["ticker"], "di", "at", ["weight"], inclusive=False).select("di", "ticker", *r6("weight"))


# ------------------------------------------------------------- event studies


def abnormal(spark, d) -> DataFrame:
    """(di, ticker, ar): each return less the day's equal-weight mean."""
    own = OWN(spark, d).where("r is not null")
    return own.select("di", "ticker", (F.col("r") - F.avg("r").over(Window.partitionBy("di"))).alias("ar"))


_AR = "(SELECT di, ticker, r - avg(r) OVER (PARTITION BY di) AS ar FROM own WHERE r IS NOT NULL)"
_STUDY = f"(SELECT e.o_orderkey, e.ticker, e.action, e.di, max(CASE WHEN a.di = e.di THEN ar END) AS ar0, max(CASE WHEN a.di = e.di + 1 THEN ar END) AS ar1, CASE WHEN count(*) FILTER (a.di BETWEEN e.di + 1 AND e.di + 5) = 5 THEN sum(ar) FILTER (a.di BETWEEN e.di + 1 AND e.di + 5) END AS car5, CASE WHEN count(*) FILTER (a.di BETWEEN e.di + 1 AND e.di + 21) = 21 THEN sum(ar) FILTER (a.di BETWEEN e.di + 1 AND e.di + 21) END AS car21 FROM {EVENTS} e LEFT JOIN {_AR} a ON a.ticker = e.ticker AND a.di BETWEEN e.di AND e.di + 21 GROUP BY 1, 2, 3, 4)"


def study(spark, d) -> DataFrame:
    """Each event with the abnormal return of its day and the next, and their sums over 5 and 21 days after; whole windows only.

    The sums are made once for each name and day, by range windows, and then meet the events of that day.
    """
    p = P(spark, d)
    days = p.select("di", "ticker").join(abnormal(spark, d), ["di", "ticker"], "left")
    w = Window.partitionBy("ticker").orderBy("di")
    total = lambda n: F.when(F.count("ar").over(w.rangeBetween(1, n)) == n, F.sum("ar").over(w.rangeBetween(1, n)))
    e = A.on_calendar(S.grades(spark, d), p).select("o_orderkey", "ticker", "action", "di")
    # a day without a row of its own still has windows
    days = days.join(e.select("di", "ticker").distinct(), ["di", "ticker"], "full")
    days = days.select("di", "ticker", F.col("ar").alias("ar0"), F.max("ar").over(w.rangeBetween(1, 1)).alias("ar1"), total(5).alias("car5"), total(21).alias("car21"))
    return e.join(days, ["di", "ticker"])


@query(f"SELECT o_orderkey, ticker, di, round(ar0, 6) AS ar0, round(ar1, 6) AS ar1, round(car5, 6) AS car5, round(car21, 6) AS car21 FROM {_STUDY}", "own grades cal")
def es_01(spark, d):
    return study(spark, d).select("o_orderkey", "ticker", "di", *r6("ar0", "ar1", "car5", "car21"))


@query(f"SELECT action, count(*) AS n, round(avg(car5), 6) AS mean, round(avg(car5) / (stddev_samp(car5) / sqrt(count(*))), 4) AS t_iid, round(avg(car5) / (sqrt(sum(c2)) / count(*)), 4) AS t_day FROM (SELECT action, car5, CASE WHEN row_number() OVER (PARTITION BY action, di) = 1 THEN pow(sum(car5 - m) OVER (PARTITION BY action, di), 2) ELSE 0 END AS c2 FROM (SELECT action, di, car5, avg(car5) OVER (PARTITION BY action) AS m FROM {_STUDY} WHERE car5 IS NOT NULL)) GROUP BY action HAVING count(*) >= 10", "own grades cal")
def es_02(spark, d):
    x = study(spark, d).where("car5 is not null")
    days = x.groupBy("action", "di").agg(F.sum("car5").alias("s"), F.count("*").alias("k"), F.sum(F.col("car5") ** 2).alias("q"))
    cut = x.groupBy("action").agg(F.count("*").alias("n"), F.avg("car5").alias("m"), F.stddev_samp("car5").alias("sd")).where("n >= 10")
    by_day = days.join(F.broadcast(cut), "action").groupBy("action").agg(F.sum((F.col("s") - F.col("k") * F.col("m")) ** 2).alias("c2"), F.max("n").alias("n"), F.max("m").alias("m"), F.max("sd").alias("sd"))  # a row per action
    return by_day.select("action", "n", F.round("m", 6).alias("mean"), F.round(F.col("m") / (F.col("sd") / F.sqrt("n")), 4).alias("t_iid"), F.round(F.col("m") / (F.sqrt("c2") / F.col("n")), 4).alias("t_day"))


@query(f"SELECT round(mu - md, 6) AS spread, round((mu - md) / sqrt(vu / nu + vd / nd), 4) AS t FROM (SELECT avg(car5) FILTER (action = 'up') AS mu, avg(car5) FILTER (action = 'down') AS md, var_samp(car5) FILTER (action = 'up') AS vu, var_samp(car5) FILTER (action = 'down') AS vd, count(car5) FILTER (action = 'up') AS nu, count(car5) FILTER (action = 'down') AS nd FROM {_STUDY})", "own grades cal")
def es_03(spark, d):
    up, down = (F.when(F.col("action") == a, F.col("car5")) for a in ("up", "down"))
    x = study(spark, d).agg(F.avg(up).alias("mu"), F.avg(down).alias("md"), (F.var_samp(up) / F.count(up) + F.var_samp(down) / F.count(down)).alias("v"))
    return x.select(F.round(F.col("mu") - F.col("md"), 6).alias("spread"), F.round((F.col("mu") - F.col("md")) / F.sqrt("v"), 4).alias("t"))


@query(f"SELECT di, round(CASE WHEN count(*) FILTER (up) > 0 AND count(*) FILTER (down) > 0 THEN avg(r) FILTER (up) - avg(r) FILTER (down) ELSE 0 END, 6) AS r FROM (SELECT o.di, o.ticker, o.r, bool_or(e.action = 'up') AS up, bool_or(e.action = 'down') AS down FROM own o JOIN {EVENTS} e ON e.ticker = o.ticker AND o.di BETWEEN e.di + 1 AND e.di + 5 WHERE o.r IS NOT NULL GROUP BY 1, 2, 3) GROUP BY di", "own grades cal")
def es_04(spark, d):
    e = A.on_calendar(S.grades(spark, d), P(spark, d)).select("ticker", "action", F.explode(F.sequence(F.col("di") + 1, F.col("di") + 5)).alias("di"))
    told = e.groupBy("ticker", "di").agg(F.bool_or(F.col("action") == "up").alias("up"), F.bool_or(F.col("action") == "down").alias("down"))
    x = OWN(spark, d).where("r is not null").join(told, ["ticker", "di"])
    up, down = (F.when(F.col(c), F.col("r")) for c in ("up", "down"))
    return x.groupBy("di").agg(F.round(F.when((F.count(up) > 0) & (F.count(down) > 0), F.avg(up) - F.avg(down)).otherwise(0.0), 6).alias("r"))


# --------------------------------------------------------------- evaluation


@query("SELECT late, round(avg(ic), 6) AS mean_ic, count(*) AS n FROM (SELECT ic, di > (SELECT quantile_cont(di, 0.5) FROM (SELECT DISTINCT di FROM mom)) AS late FROM (SELECT di, corr(a, b) AS ic FROM (SELECT mom.di, " + RANK.format("value").replace("BY di", "BY mom.di") + " AS a, " + RANK.format("fwd").replace("BY di", "BY mom.di") + " AS b FROM mom JOIN fwd ON mom.di = fwd.di AND mom.ticker = fwd.ticker) GROUP BY di HAVING count(*) >= 10)) GROUP BY late", "mom fwd")
def ic_04(spark, d):
    p = P(spark, d)
    m = momentum(p)
    mid = m.select("di").distinct().agg(F.percentile("di", 0.5).alias("mid"))
    return daily_ic(m, forward(p)).crossJoin(F.broadcast(mid)).groupBy((F.col("di") > F.col("mid")).alias("late")).agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.count("*").alias("n"))  # one row


@query(f"SELECT round(avg(c), 6) AS mean, count(*) AS days FROM (SELECT di, corr(a, b) AS c FROM (SELECT di, {RANK.format('y')} AS a, {RANK.format('x1')} AS b FROM {_THREE}) GROUP BY di HAVING count(*) >= 8) WHERE c IS NOT NULL", "mom mom21 mom5")
def ic_05(spark, d):
    x = three(P(spark, d)).select("di", X.average_rank("y").alias("a"), X.average_rank("x1").alias("b"))
    return x.groupBy("di").agg(F.when(F.count("*") >= 8, F.corr("a", "b")).alias("c")).where("c is not null").agg(F.round(F.avg("c"), 6).alias("mean"), F.count("*").alias("days"))


_PAIRED = "(SELECT l.ticker, l.di, l.date, l.signal, l.cls, m.value AS pred FROM lab l JOIN mom m ON m.di = l.di AND m.ticker = l.ticker)"


def paired(spark, d) -> DataFrame:
    """(ticker, di, date, signal, cls, pred): labelled days with the prediction that momentum makes."""
    p = P(spark, d)
    return classes(signal(p)).join(momentum(p).select("di", "ticker", F.col("value").alias("pred")), ["di", "ticker"])


@query(f"SELECT round((SELECT avg(c) FROM (SELECT ticker, corr(a, b) AS c FROM (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY pred) + (count(*) OVER (PARTITION BY ticker, pred) - 1) / 2.0 AS a, rank() OVER (PARTITION BY ticker ORDER BY signal) + (count(*) OVER (PARTITION BY ticker, signal) - 1) / 2.0 AS b FROM {_PAIRED}) GROUP BY 1 HAVING count(*) > 30)), 6) AS per_ticker, round((sum(w * a * b) / sum(w) - sum(w * a) / sum(w) * sum(w * b) / sum(w)) / sqrt((sum(w * a * a) / sum(w) - pow(sum(w * a) / sum(w), 2)) * (sum(w * b * b) / sum(w) - pow(sum(w * b) / sum(w), 2))), 6) AS tail FROM (SELECT a, b, 2 * abs(b - 0.5) AS w FROM (SELECT (rank() OVER (PARTITION BY di ORDER BY pred) + (count(*) OVER (PARTITION BY di, pred) - 1) / 2.0) / count(*) OVER (PARTITION BY di) AS a, (rank() OVER (PARTITION BY di ORDER BY signal) + (count(*) OVER (PARTITION BY di, signal) - 1) / 2.0) / count(*) OVER (PARTITION BY di) AS b FROM {_PAIRED}))", "lab mom")
def ic_06(spark, d):
    x = paired(spark, d)
    own = x.select("ticker", X.average_rank("pred", "ticker").alias("a"), X.average_rank("signal", "ticker").alias("b")).groupBy("ticker").agg(F.when(F.count("*") > 30, F.corr("a", "b")).alias("c")).agg(F.round(F.avg("c"), 6).alias("per_ticker"))
    t = x.select(X.pct_rank("pred").alias("a"), X.pct_rank("signal").alias("b")).withColumn("w", 2 * F.abs(F.col("b") - 0.5))
    m = lambda e: F.sum(F.col("w") * e) / F.sum("w")
    a, b = F.col("a"), F.col("b")
    tail = t.agg(F.round((m(a * b) - m(a) * m(b)) / F.sqrt((m(a * a) - m(a) ** 2) * (m(b * b) - m(b) ** 2)), 6).alias("tail"))
    return own.crossJoin(F.broadcast(tail))  # one row each


#: Rewards of a decision (row) against the truth (column), both from the worst to the best class.
REWARDS = (
    (1.00, 0.75, -1.25, -2.00, -2.00),
    (0.75, 1.00, -0.75, -1.50, -2.00),
    (-1.50, -1.00, 1.00, -1.00, -1.50),
    (-1.75, -1.25, -0.75, 1.00, 0.75),
    (-2.25, -1.50, -1.25, 0.75, 1.00),
)
#: Fixed value: the reward of an answer without a decision.
INVALID = -2.5
REWARD_ROWS = ", ".join(f"('{p}', '{t}', {REWARDS[i][j]:.2f})" for i, p in enumerate(CLASSES) for j, t in enumerate(CLASSES))
_SAID = f"(SELECT ticker, di, date, signal, cls, pred, CASE WHEN pct >= 0.9 THEN 'STRONG_BUY' WHEN pct >= 0.6 THEN 'BUY' WHEN pct >= 0.4 THEN 'HOLD' WHEN pct >= 0.1 THEN 'SELL' ELSE 'STRONG_SELL' END AS said FROM (SELECT *, ({RANK.format('pred')}) / count(*) OVER (PARTITION BY di) AS pct FROM {_PAIRED}))"


def rewards(spark) -> DataFrame:
    """(said, cls, reward): 25 rows."""
    return spark.createDataFrame([(p, t, REWARDS[i][j]) for i, p in enumerate(CLASSES) for j, t in enumerate(CLASSES)], "said string, cls string, reward double")


def said(spark, d) -> DataFrame:
    """Labelled days with the class that momentum's rank of the day says."""
    x = paired(spark, d).withColumn("pct", X.pct_rank("pred"))
    call = F.lit(CLASSES[0])
    for cut, c in zip((0.1, 0.4, 0.6, 0.9), CLASSES[1:], strict=True):
        call = F.when(F.col("pct") >= cut, c).otherwise(call)
    return x.withColumn("said", call)


def level(c: str) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), F.col(c))


_LEVEL = "list_position(['" + "', '".join(CLASSES) + "'], {0})"


@query(f"SELECT count(*) AS n, round(avg((said = cls)::INT), 6) AS accuracy, round(avg(abs({_LEVEL.format('said')} - {_LEVEL.format('cls')})), 6) AS mae, (SELECT bool_and(m >= coalesce(before, m)) FROM (SELECT m, lag(m) OVER (ORDER BY k) AS before FROM (SELECT {_LEVEL.format('said')} AS k, avg(signal) AS m FROM {_SAID} GROUP BY 1 HAVING count(*) >= 20))) AS monotonic FROM {_SAID}", "lab mom")
def ic_07(spark, d):
    x = said(spark, d)
    by = x.groupBy(level("said").alias("k")).agg(F.avg("signal").alias("m"), F.count("*").alias("n")).where("n >= 20")
    mono = by.withColumn("before", F.lag("m").over(Window.orderBy("k"))).agg(F.bool_and(F.col("m") >= F.coalesce("before", "m")).alias("monotonic"))  # five rows
    y = x.agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("cls")).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.abs(level("said") - level("cls"))), 6).alias("mae"))
    return y.crossJoin(F.broadcast(mono))  # one row each


@query(f"SELECT *, mean > best_constant AS passed FROM (SELECT round(avg(r.reward), 6) AS mean, round((SELECT max(m) FROM (SELECT r.said, avg(r.reward) AS m FROM lab l JOIN (VALUES {REWARD_ROWS}) r(said, cls, reward) ON r.cls = l.cls JOIN mom ON mom.di = l.di AND mom.ticker = l.ticker GROUP BY 1)), 6) AS best_constant, round((SELECT avg(r.reward) FROM {_SAID} x JOIN (VALUES {REWARD_ROWS}) r(said, cls, reward) ON r.cls = x.cls AND r.said = 'HOLD'), 6) AS always_hold FROM {_SAID} x JOIN (VALUES {REWARD_ROWS}) r(said, cls, reward) ON r.cls = x.cls AND r.said = x.said)", "lab mom")
def ic_08(spark, d):
    x, r = said(spark, d), rewards(spark)
    mean = x.join(F.broadcast(r), ["said", "cls"]).agg(F.round(F.avg("reward"), 6).alias("mean"))
    constant = x.groupBy("cls").agg(F.count("*").alias("n")).join(F.broadcast(r), "cls").groupBy("said").agg((F.sum(F.col("reward") * F.col("n")) / F.sum("n")).alias("m"))
    best = constant.agg(F.round(F.max("m"), 6).alias("best_constant"), F.round(F.max(F.when(F.col("said") == "HOLD", F.col("m"))), 6).alias("always_hold"))
    return mean.crossJoin(F.broadcast(best)).withColumn("passed", F.col("mean") > F.col("best_constant"))  # one row each


@query(f"SELECT ticker, round(ic, 6) AS ic, round(profit, 6) AS profit, CASE WHEN ic > 0 AND profit > 0 THEN 'skill' WHEN ic > 0 THEN 'unpaid' WHEN profit > 0 THEN 'luck' ELSE 'neither' END AS quadrant FROM (SELECT ticker, corr(pred, signal) AS ic, sum(CASE WHEN said IN ('BUY', 'STRONG_BUY') THEN f.fwd ELSE 0 END) AS profit FROM {_SAID} x JOIN fwd f USING (di, ticker) GROUP BY 1)", "lab mom fwd")
def ic_09(spark, d):
    x = said(spark, d).join(forward(P(spark, d)), ["di", "ticker"])
    g = x.groupBy("ticker").agg(F.corr("pred", "signal").alias("ic"), F.sum(F.when(F.col("said").isin("BUY", "STRONG_BUY"), F.col("fwd")).otherwise(0.0)).alias("profit"))
    q = F.when((F.col("ic") > 0) & (F.col("profit") > 0), "skill").when(F.col("ic") > 0, "unpaid").when(F.col("profit") > 0, "luck").otherwise("neither")
    return g.select("ticker", *r6("ic", "profit"), q.alias("quadrant"))


@query("SELECT w.half, count(*) FILTER (p.di < w.first - 15) AS train_rows, count(*) FILTER (p.di BETWEEN w.first AND w.last) AS test_rows FROM (SELECT year(date) * 2 + (month(date) > 6)::INT AS half, min(di) AS first, max(di) AS last FROM cal GROUP BY 1) w, p GROUP BY 1")
def ic_10(spark, d):
    p = P(spark, d)
    days = p.groupBy("date", "di").agg(F.count("*").alias("n")).withColumn("half", (F.year("date") * 2 + (F.month("date") > 6).cast("int")).cast("long"))
    halves = days.groupBy("half").agg(F.min("di").alias("first"), F.max("di").alias("last"), F.sum("n").alias("test_rows"))
    # a row per calendar day: rows before the label-complete cut are a running count
    before = days.select(F.lit(1).alias("all"), (F.col("di") + 15).alias("at"), F.sum("n").over(Window.orderBy("di")).alias("train_rows"))
    cut = A.asof(halves.withColumn("all", F.lit(1)), before, ["all"], "first", "at", ["train_rows"], inclusive=False)
    return cut.select("half", F.coalesce("train_rows", F.lit(0)).cast("long").alias("train_rows"), "test_rows")


@query(f"SELECT said, cls, count(*) AS n FROM {_SAID} GROUP BY 1, 2", "lab mom")
def ic_11(spark, d):
    return said(spark, d).groupBy("said", "cls").agg(F.count("*").alias("n"))


@query("SELECT y, count(*) AS n, round(avg(r) * 252, 6) AS ann, round(avg(-r) FILTER (-r >= q), 6) AS cvar, round(avg(exposure), 6) AS exposure FROM (SELECT *, quantile_cont(-r, 0.85) OVER (PARTITION BY y) AS q FROM (SELECT year(date) AS y, r, CASE WHEN count(r) OVER w < 126 THEN 1 ELSE coalesce(greatest(0, least(1, 0.5 * avg(r) OVER w / nullif(var_samp(r) OVER w, 0))), 1) END AS exposure FROM ls WINDOW w AS (ORDER BY di ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING))) GROUP BY y", "ls")
def met_03_windows(spark, d):
    p = P(spark, d)
    x = R.kelly(one(ls_returns(p, momentum(p))), n=126).withColumn("y", F.year("date").cast("long"))
    x = x.withColumn("q", F.percentile(-F.col("r"), 0.85).over(Window.partitionBy("y")))
    return x.groupBy("y").agg(F.count("*").alias("n"), F.round(F.avg("r") * 252, 6).alias("ann"), F.round(F.avg(F.when(-F.col("r") >= F.col("q"), -F.col("r"))), 6).alias("cvar"), F.round(F.avg("exposure"), 6).alias("exposure"))


@query("SELECT a.ticker AS a, b.ticker AS b, round(covar_samp(a.r, b.r), 8) AS cov FROM own a JOIN own b ON a.di = b.di AND a.ticker <= b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL AND a.di > (SELECT max(di) FROM cal) - 60 GROUP BY 1, 2", "own cal")
def agg_08(spark, d):
    r = OWN(spark, d)
    last = r.agg(F.max("di").alias("last"))
    r = r.crossJoin(F.broadcast(last)).where("di > last - 60 and r is not null").select("di", "ticker", "r")  # one row
    return r.alias("a").join(r.alias("b"), "di").where("a.ticker <= b.ticker").groupBy(F.col("a.ticker").alias("a"), F.col("b.ticker").alias("b")).agg(F.round(F.covar_samp("a.r", "b.r"), 8).alias("cov"))


@query("SELECT di, ticker, 1 + floor((rn - 1) * 5.0 / n)::BIGINT AS bucket FROM (SELECT di, ticker, row_number() OVER (PARTITION BY di ORDER BY value, ticker) AS rn, count(*) OVER (PARTITION BY di) AS n FROM mom)", "mom")
def win_17_buckets(spark, d):
    w = Window.partitionBy("di")
    x = momentum(P(spark, d)).withColumns({"rn": F.row_number().over(w.orderBy("value", "ticker")), "n": F.count("*").over(w)})
    return x.select("di", "ticker", (1 + F.floor((F.col("rn") - 1) * 5.0 / F.col("n"))).cast("long").alias("bucket"))


@query("SELECT m.di, m.ticker, round(m.value, 6) AS value, round(f.fwd, 6) AS fwd FROM mom m JOIN fwd f ON f.di = m.di AND f.ticker = m.ticker", "mom fwd")
def jn_01(spark, d):
    p = P(spark, d)
    return momentum(p).join(forward(p), ["di", "ticker"]).select("di", "ticker", *r6("value", "fwd"))


@query("SELECT p.di, p.ticker, round(m.value, 6) AS value FROM p LEFT JOIN mom m ON m.di = p.di AND m.ticker = p.ticker", "p mom")
def jn_02(spark, d):
    p = P(spark, d)
    return p.select("di", "ticker").join(momentum(p).select("di", "ticker", "value"), ["di", "ticker"], "left").select("di", "ticker", *r6("value"))


@query("SELECT DISTINCT a.y, a.company, a.ticker AS a, b.ticker AS b FROM (SELECT DISTINCT year(date) AS y, ticker, company FROM grades) a JOIN (SELECT DISTINCT year(date) AS y, ticker, company FROM grades) b ON a.y = b.y AND a.company = b.company AND a.ticker <> b.ticker", "grades")
def jn_10(spark, d):
    x = S.grades(spark, d).select(F.year("date").cast("long").alias("y"), "company", "ticker").distinct()
    return PR.mirrored(PR.pairs(x, ["y", "company"], "ticker"))


@query("SELECT bps, lag, round(avg(r - bps / 10000.0), 6) AS mean FROM (SELECT bps, lag, w.di + lag AS di, sum(weight * coalesce(fwd, 0)) AS r FROM quint w CROSS JOIN (VALUES (5), (10)) a(bps) CROSS JOIN (VALUES (0), (1)) b(lag) LEFT JOIN fwd ON fwd.di = w.di + lag AND fwd.ticker = w.ticker GROUP BY 1, 2, 3) GROUP BY 1, 2", "quint fwd")
def jn_13(spark, d):
    """The mean net return for each cost and each delay of the weights."""
    p = P(spark, d)
    grid = spark.createDataFrame([(b, k) for b in (5, 10) for k in (0, 1)], "bps int, lag int")
    w = quintile_weights(momentum(p)).select("di", "ticker", "weight").crossJoin(F.broadcast(grid)).withColumn("di", F.col("di") + F.col("lag"))  # four parameter rows
    r = w.join(forward(p), ["di", "ticker"], "left").groupBy("bps", "lag", "di").agg(F.sum(F.col("weight") * F.coalesce("fwd", F.lit(0.0))).alias("r"))
    return r.groupBy("bps", "lag").agg(F.round(F.avg(F.col("r") - F.col("bps") / 10000.0), 6).alias("mean"))


@query("SELECT c.di, n.ticker, round(p.close, 6) AS close FROM cal c CROSS JOIN (SELECT DISTINCT ticker FROM p) n LEFT JOIN p ON p.di = c.di AND p.ticker = n.ticker", "p")
def prj_03(spark, d):
    p = P(spark, d)
    # every name has each day between the calendar's ends: a sequence for each name, no product of tables
    ends = p.agg(F.min("di").alias("lo"), F.max("di").alias("hi"))
    names = p.select("ticker").distinct().crossJoin(F.broadcast(ends))  # one row
    grid = names.select("ticker", F.explode(F.sequence("lo", "hi")).alias("di"))
    return grid.join(p.select("di", "ticker", "close"), ["di", "ticker"], "left").select("di", "ticker", *r6("close"))


_SNAP = "(SELECT y, ticker FROM (SELECT year(date) + 1 AS y, ticker, row_number() OVER (PARTITION BY year(date) ORDER BY sum(volume) DESC, ticker) AS k FROM p GROUP BY year(date), ticker) WHERE k <= 15)"


def membership(p: DataFrame, top: int = 15) -> DataFrame:
    """(snap, tickers): at the start of each year, the names of the largest volume of the year before, as a comma list."""
    v = p.groupBy((F.year("date") + 1).alias("y"), "ticker").agg(F.sum("volume").alias("v"))
    k = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("v"), "ticker"))
    return v.withColumn("k", k).where(F.col("k") <= top).groupBy("y").agg(F.array_join(F.sort_array(F.collect_list(F.col("ticker").cast("string"))), ",").alias("tickers")).select(F.make_date("y", F.lit(1), F.lit(1)).alias("snap"), "tickers")


def members(p: DataFrame) -> DataFrame:
    """(date, ticker): the names of the last snapshot at or before each day."""
    days = p.select("date").distinct().withColumn("all", F.lit(1))
    dated = A.asof(days, membership(p).withColumn("all", F.lit(1)), ["all"], "date", "snap", ["tickers"])
    return dated.where("tickers is not null").select("date", F.explode(F.split("tickers", ",")).alias("ticker")).select("date", F.col("ticker").cast("int").alias("ticker"))


@query(f"SELECT c.date, s.ticker FROM cal c JOIN {_SNAP} s ON s.y = year(c.date)", "p cal")
def jn_07(spark, d):
    return members(P(spark, d))


SPAN = ("1997-07-01", "1999-06-30")


@query(f"SELECT DISTINCT ticker FROM {_SNAP} WHERE make_date(y, 1, 1) <= DATE '{SPAN[1]}' AND make_date(y, 1, 1) >= (SELECT max(make_date(y, 1, 1)) FROM {_SNAP} WHERE make_date(y, 1, 1) <= DATE '{SPAN[0]}')", "p")
def set_04(spark, d):
    """All names of the index over a span: of the last snapshot at or before its start, and of those until its end."""
    snaps = membership(P(spark, d)).where(F.col("snap") <= F.to_date(F.lit(SPAN[1])))
    first = snaps.agg(F.max(F.when(F.col("snap") <= F.to_date(F.lit(SPAN[0])), F.col("snap"))).alias("first"))
    held = snaps.crossJoin(F.broadcast(first)).where("first is null or snap >= first")  # one row
    return held.select(F.explode(F.split("tickers", ",")).alias("ticker")).select(F.col("ticker").cast("int").alias("ticker")).distinct()


#: Names of the first panel, names of the second one (some in both), and when a name took another symbol.
FIRST, SECOND = 15, 10


def symbols(p: DataFrame) -> DataFrame:
    """(ticker, symbol, since, until): the symbols of each name with the days on which they hold, until excluded; every third name is renamed."""
    names = p.select("ticker").distinct()
    day = F.date_add(F.lit("1997-01-06").cast("date"), F.col("ticker") * 30)
    old = F.struct(F.concat(F.lit("S"), F.col("ticker").cast("string")).alias("symbol"), F.lit("1900-01-01").cast("date").alias("since"), F.when(F.col("ticker") % 3 == 0, day).otherwise(F.lit("9999-12-31").cast("date")).alias("until"))
    new = F.struct(F.concat(F.lit("R"), F.col("ticker").cast("string")).alias("symbol"), day.alias("since"), F.lit("9999-12-31").cast("date").alias("until"))
    return names.select("ticker", F.explode(F.when(F.col("ticker") % 3 == 0, F.array(old, new)).otherwise(F.array(old))).alias("x")).select("ticker", "x.*")


def canonical(rows: DataFrame, names: DataFrame, day: str) -> DataFrame:
    """rows (symbol, day, ...) with the ticker that the symbol stood for on the day, by an as-of join; symbols out of their time go."""
    got = A.asof(rows, names.select("symbol", "since", "until", "ticker"), ["symbol"], day, "since", ["until", "ticker"])
    return got.where(F.col(day) < F.col("until")).drop("until", "matched")


def arms(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arm, date, di, ticker, value, fwd) of three universes, and (date, members, with_data) of the days.

    as_is: the first panel; members: its names on days when they belong to the index, returns between two such days alone; full:
    names of both panels, the second one by the symbols of its time, on days when they belong and have a price.
    """
    first = p.where(F.col("ticker") < FIRST).select("date", "di", "ticker", "close")
    names = symbols(p)
    # the second panel comes by the symbols of its days, and so do the snapshots of the index
    said = lambda x, day: x.join(names, "ticker").where((F.col(day) >= F.col("since")) & (F.col(day) < F.col("until")))
    second = said(p.where(F.col("ticker") >= SECOND), "date").select("symbol", "date", "di", "close")
    second = canonical(second, names, "date").select("date", "di", "ticker", "close")
    full = first.unionByName(second.join(first.select("ticker").distinct(), "ticker", "left_anti"))
    listed = canonical(said(members(p), "date").select("symbol", "date"), names, "date").select("date", "ticker").distinct()
    eligible = full.join(listed, ["date", "ticker"], "left_semi")
    days = listed.groupBy("date").agg(F.count("*").alias("members")).join(eligible.groupBy("date").agg(F.count("*").alias("with_data")), "date", "left")

    def arm(name: str, panel: DataFrame, signals: DataFrame) -> DataFrame:
        there = panel.select("date", "di", "ticker", "close")
        return momentum(signals).join(there.select("di", "ticker"), ["di", "ticker"], "left_semi").join(forward(there), ["di", "ticker"]).withColumn("arm", F.lit(name))

    return arm("as_is", first, first).unionByName(arm("members", first.join(listed, ["date", "ticker"], "left_semi"), first)).unionByName(arm("full", eligible, full)), days


_ARM = "avg(CASE WHEN value >= q80 THEN fwd END) - avg(CASE WHEN value <= q20 THEN fwd END)"
#: The universes in plain terms: renaming gives back the names themselves, so the panels are cut by ticker alone.
_UNIVERSES = f"""listed AS (SELECT c.date, c.di, s.ticker FROM cal c JOIN {_SNAP} s ON s.y = year(c.date)), el AS (SELECT p.date, p.di, p.ticker, close FROM p JOIN listed l ON l.date = p.date AND l.ticker = p.ticker),
    universe AS (SELECT 'as_is' AS arm, date, di, ticker, close FROM p WHERE ticker < {FIRST} UNION ALL SELECT 'members', * FROM el WHERE ticker < {FIRST} UNION ALL SELECT 'full', * FROM el),
    arms AS (SELECT u.arm, u.date, u.di, m.value, v.close / u.close - 1 AS fwd FROM universe u JOIN universe v ON v.arm = u.arm AND v.ticker = u.ticker AND v.di = u.di + 1 JOIN mom m ON m.di = u.di AND m.ticker = u.ticker),
    days AS (SELECT l.date, count(*) AS members, count(el.ticker) AS with_data FROM listed l LEFT JOIN el ON el.date = l.date AND el.ticker = l.ticker GROUP BY 1), cover AS (SELECT year(date) AS y, round(avg(members), 6) AS members, round(avg(with_data / members::DOUBLE), 6) AS coverage FROM days GROUP BY 1)"""


@query(f", {_UNIVERSES} SELECT arm, y, round(avg(r), 6) AS mean, round(avg(names), 6) AS names, any_value(members) AS members, any_value(coverage) AS coverage FROM (SELECT arm, date, year(date) AS y, {_ARM} AS r, count(*) AS names FROM (SELECT *, quantile_cont(value, 0.8) OVER (PARTITION BY arm, di) AS q80, quantile_cont(value, 0.2) OVER (PARTITION BY arm, di) AS q20 FROM arms) GROUP BY 1, 2) LEFT JOIN cover USING (y) WHERE r IS NOT NULL GROUP BY 1, 2", "p cal mom")
def bt_07(spark, d):
    """Three universes by year: the panel as it is, its index members, and all members of the time, with how many members have data."""
    x, days = arms(P(spark, d))
    q = F.percentile("value", F.array(F.lit(0.8), F.lit(0.2))).over(Window.partitionBy("arm", "di"))
    r = x.withColumn("q", q).groupBy("arm", "date").agg((F.avg(F.when(F.col("value") >= F.col("q")[0], F.col("fwd"))) - F.avg(F.when(F.col("value") <= F.col("q")[1], F.col("fwd")))).alias("r"), F.count("*").alias("names")).where("r is not null")
    cover = days.groupBy(F.year("date").cast("long").alias("y")).agg(F.round(F.avg("members"), 6).alias("members"), F.round(F.avg(F.coalesce("with_data", F.lit(0)) / F.col("members")), 6).alias("coverage"))
    return r.groupBy("arm", F.year("date").cast("long").alias("y")).agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.avg("names"), 6).alias("names")).join(cover, "y", "left").select("arm", "y", "mean", "names", "members", "coverage")


_SLICED = f"SELECT z.slice, m.di, m.date, m.ticker, m.value, f.fwd FROM mom m JOIN fwd f USING (di, ticker) LEFT JOIN {_SNAP} s ON s.y = year(m.date) AND s.ticker = m.ticker JOIN (VALUES ('all'), ('members'), ('others')) z(slice) ON z.slice = 'all' OR (z.slice = 'members') = (s.ticker IS NOT NULL)"
_BY_SLICE = "rank() OVER (PARTITION BY slice, di ORDER BY {0}) + (count(*) OVER (PARTITION BY slice, di, {0}) - 1) / 2.0"


@query(f"SELECT slice, y, round(avg(ic), 6) AS mean_ic, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t, count(*) AS n FROM (SELECT slice, year(date) AS y, di, corr(a, b) AS ic FROM (SELECT slice, date, di, {_BY_SLICE.format('value')} AS a, {_BY_SLICE.format('fwd')} AS b FROM ({_SLICED})) GROUP BY 1, 2, 3 HAVING count(*) >= 8) WHERE NOT isnan(ic) GROUP BY slice, ROLLUP (y)", "p mom fwd")
def ic_02(spark, d):
    """The mean rank correlation by year and over all, for the whole universe, index members and the rest; ranks within each."""
    p = P(spark, d)
    both = momentum(p).join(forward(p), ["di", "ticker"]).join(members(p).withColumn("in", F.lit(True)), ["date", "ticker"], "left")
    slices = F.array(F.lit("all"), F.when(F.col("in"), "members").otherwise("others"))
    x = both.withColumn("slice", F.explode(slices)).withColumn("day", F.struct("slice", "di"))
    ranked = x.select("slice", "date", "di", X.average_rank("value", "day").alias("a"), X.average_rank("fwd", "day").alias("b"))
    ic = ranked.groupBy("slice", F.year("date").cast("long").alias("y"), "di").agg(F.corr("a", "b").alias("ic"), F.count("*").alias("k")).where("k >= 8 and ic is not null and not isnan(ic)")
    out = [F.round(F.avg("ic"), 6).alias("mean_ic"), F.round(F.avg("ic") / F.stddev_samp("ic") * F.sqrt(F.count("*")), 4).alias("t"), F.count("*").alias("n")]
    years, all_ = ic.groupBy("slice", "y").agg(*out), ic.groupBy("slice").agg(*out).withColumn("y", F.lit(None).cast("long"))
    return years.unionByName(all_)
