"""Queries over the panel: joins, windows, cross-sections, signals, portfolios, metrics and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import metrics as M
from tidepanel.operators import asof as A
from tidepanel.operators import order as O
from tidepanel.operators import pairs as PR
from tidepanel.operators import risk as R
from tidepanel.operators import windows as W
from tidepanel.operators import xsection as X
from tidepanel.sources import fixtures as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, needs: str = "p"):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = S.with_sql(needs, sql) if needs else sql
        return f

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def P(spark, d) -> DataFrame:
    return S.numbered(S.panel(spark, d)).withColumn("di", F.col("di").cast("long"))


def momentum(p: DataFrame, k: int = 10) -> DataFrame:
    """(date, di, ticker, value): return over k calendar positions."""
    return W.shift_calendar(p.select("date", "di", "ticker", "close"), "close", k, "b").where("b is not null").select("date", "di", "ticker", (F.col("close") / F.col("b") - 1).alias("value"))


def forward(p: DataFrame, k: int = 1) -> DataFrame:
    return W.shift_calendar(p.select("di", "ticker", "close"), "close", -k, "b").where("b is not null").select("di", "ticker", (F.col("b") / F.col("close") - 1).alias("fwd"))


def ls_returns(p: DataFrame, s: DataFrame) -> DataFrame:
    """(date, di, r): mean forward return of the top leg less that of the bottom leg; days with an empty leg go."""
    up, down = (F.avg(F.when(F.col(c), F.col("fwd"))) for c in ("up", "down"))
    return X.legs(s).join(forward(p), ["di", "ticker"]).groupBy("date", "di").agg((up - down).alias("r")).where("r is not null")


def one(r: DataFrame, name: str = "ls") -> DataFrame:
    return r.withColumn("stream_id", F.lit(name))


STAT = "avg(r) * 252 AS ann, stddev_pop(r) * sqrt(252) AS vol, avg(r) * 252 / (stddev_pop(r) * sqrt(252)) AS sharpe"
ROUND = "round(ann, 6) AS ann, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe, round(mdd, 6) AS mdd, round(cvar, 6) AS cvar"


@query("SELECT date, di, round(r, 6) AS r FROM ls", "ls")
def minimum_slice(spark, d):
    p = P(spark, d)
    return ls_returns(p, momentum(p)).select("date", "di", *r6("r"))


@query(f"SELECT 'ls' AS stream_id, {ROUND} FROM (SELECT {STAT} FROM ls), (SELECT max(1 - eq / pk) AS mdd FROM (SELECT eq, max(eq) OVER (ORDER BY di) AS pk FROM (SELECT di, product(1 + r) OVER (ORDER BY di) AS eq FROM ls))), (SELECT avg(-r) AS cvar FROM ls WHERE -r >= (SELECT quantile_cont(-r, 0.85) FROM ls))", "ls")
def met_02(spark, d):
    p = P(spark, d)
    return M.stat_row(one(ls_returns(p, momentum(p)))).select("stream_id", *r6("ann", "vol", "sharpe", "mdd", "cvar"))


@query("SELECT 'ls' AS stream_id, round(cr, 6) AS cr, round(sr, 6) AS sr, round(hr, 6) AS hr, round(mdd, 6) AS mdd FROM (SELECT product(1 + r) - 1 AS cr, avg(r - 0.04 / 252) / stddev_pop(r - 0.04 / 252) * sqrt(252) AS sr, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS hr FROM ls), (SELECT max(1 - eq / pk) AS mdd FROM (SELECT eq, max(eq) OVER (ORDER BY di) AS pk FROM (SELECT di, product(1 + r) OVER (ORDER BY di) AS eq FROM ls)))", "ls")
def met_01(spark, d):
    p = P(spark, d)
    return M.metrics(one(ls_returns(p, momentum(p)))).select("stream_id", *r6("cr", "sr", "hr", "mdd"))


@query("SELECT year(date) AS y, round(avg(r) * 252, 6) AS ann, count(*) AS n FROM ls GROUP BY 1", "ls")
def met_03(spark, d):
    p = P(spark, d)
    return ls_returns(p, momentum(p)).groupBy(F.year("date").cast("long").alias("y")).agg((F.avg("r") * 252).alias("ann"), F.count("*").alias("n")).select("y", *r6("ann"), "n")


@query("SELECT di, ticker, round(value, 6) AS value FROM mom", "mom")
def sig_01(spark, d):
    return momentum(P(spark, d)).select("di", "ticker", *r6("value"))


@query("SELECT p.di, p.ticker, round(b.close, 6) AS before FROM p LEFT JOIN p b ON p.ticker = b.ticker AND b.di = p.di - 1")
def win_01(spark, d):
    return W.shift_calendar(P(spark, d).select("di", "ticker", "close"), "close", 1, "before").select("di", "ticker", *r6("before"))


@query("SELECT di, ticker, round(lag(close, 7) OVER w, 6) AS before, round(lead(close, 3) OVER w, 6) AS later FROM p WINDOW w AS (PARTITION BY ticker ORDER BY di)")
def win_02(spark, d):
    return P(spark, d).select("di", "ticker", W.shift_own("close", 7).alias("before"), W.shift_own("close", -3).alias("later")).select("di", "ticker", *r6("before", "later"))


@query("SELECT di, ticker, round(close / lag(close) OVER w - 1, 6) AS simple, round(ln(close) - ln(lag(close) OVER w), 6) AS logr FROM p WINDOW w AS (PARTITION BY ticker ORDER BY di)")
def win_03(spark, d):
    b = W.shift_own("close", 1)
    return P(spark, d).select("di", "ticker", F.round(F.col("close") / b - 1, 6).alias("simple"), F.round(F.ln("close") - F.ln(b), 6).alias("logr"))


@query("SELECT p.di, p.ticker, h, round(b.close / p.close - 1, 6) AS fwd FROM p, (VALUES (1), (3), (5), (7), (10), (15)) t(h), p b WHERE b.ticker = p.ticker AND b.di = p.di + h")
def win_04(spark, d):
    p = P(spark, d)
    ahead = p.select("di", "ticker", "close", F.explode(F.array(*map(F.lit, (1, 3, 5, 7, 10, 15)))).alias("h"))
    other = p.select("ticker", F.col("di").alias("at"), F.col("close").alias("b"))
    return ahead.withColumn("at", F.col("di") + F.col("h")).join(other, ["ticker", "at"]).select("di", "ticker", "h", F.round(F.col("b") / F.col("close") - 1, 6).alias("fwd"))


@query("SELECT di, ticker, CASE WHEN count(r) OVER w >= 20 THEN round(stddev_samp(r) OVER w, 6) END AS sd, CASE WHEN count(r) OVER w >= 10 THEN round(avg(r) OVER w, 6) END AS mean FROM own WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "own")
def win_05(spark, d):
    return OWN(spark, d).select("di", "ticker", W.rolling(F.stddev_samp, "r", 20).alias("sd"), W.rolling(F.avg, "r", 20, 10).alias("mean")).select("di", "ticker", *r6("sd", "mean"))


def OWN(spark, d) -> DataFrame:
    return P(spark, d).withColumn("r", F.col("close") / W.shift_own("close", 1) - 1)


@query('SELECT "user", date, round(sum(value) OVER (PARTITION BY "user" ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), 4) AS total FROM daily', "daily")
def win_06(spark, d):
    w = Window.partitionBy("user").orderBy(F.datediff("date", F.lit("1970-01-01"))).rangeBetween(-6, 0)
    return S.daily(spark, d).select("user", "date", F.round(F.sum("value").over(w), 4).alias("total"))


@query("SELECT di, ticker, CASE WHEN count(r) OVER w >= 30 THEN round(avg(r) OVER w, 6) END AS mean, CASE WHEN count(r) OVER w >= 30 THEN round(stddev_samp(r) OVER w, 6) END AS sd FROM own WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "own")
def win_07(spark, d):
    return OWN(spark, d).select("di", "ticker", W.past(F.avg, "r", 30).alias("mean"), W.past(F.stddev_samp, "r", 30).alias("sd")).select("di", "ticker", *r6("mean", "sd"))


@query("SELECT a.di, a.ticker, round(sum(b.close * pow(0.5, a.rn - b.rn)) / sum(pow(0.5, a.rn - b.rn)), 6) AS ema FROM q a JOIN q b ON a.ticker = b.ticker AND b.rn <= a.rn GROUP BY 1, 2".replace("FROM q a JOIN q b", "FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY di) AS rn FROM p) a JOIN (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY di) AS rn FROM p) b"))
def win_08(spark, d):
    return W.with_ewm(P(spark, d), "ema", "close", span=3).select("di", "ticker", *r6("ema"))


RANKED = "(SELECT *, rank() OVER (PARTITION BY di ORDER BY value) + (count(*) OVER (PARTITION BY di, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY di) AS n FROM mom)"


@query(f"SELECT di, ticker, round(rk, 6) AS rk, round(rk / n, 6) AS pct FROM {RANKED}", "mom")
def win_09(spark, d):
    return momentum(P(spark, d)).select("di", "ticker", X.average_rank("value").alias("rk"), X.pct_rank("value").alias("pct")).select("di", "ticker", *r6("rk", "pct"))


@query("SELECT di, ticker, rn FROM (SELECT di, ticker, row_number() OVER (PARTITION BY di ORDER BY value DESC, ticker) AS rn FROM mom) WHERE rn <= 5", "mom")
def win_10(spark, d):
    w = Window.partitionBy("di").orderBy(F.desc("value"), "ticker")
    return momentum(P(spark, d)).withColumn("rn", F.row_number().over(w).cast("long")).where("rn <= 5").select("di", "ticker", "rn")


@query(f"SELECT di, ticker, round((rk - avg(rk) OVER (PARTITION BY di)) / nullif(stddev_samp(rk) OVER (PARTITION BY di), 0), 6) AS z FROM {RANKED}", "mom")
def win_11(spark, d):
    return X.rank_z(momentum(P(spark, d)), "value", "z").select("di", "ticker", *r6("z"))


@query("SELECT di, round(eq, 6) AS equity, round(1 - eq / max(eq) OVER (ORDER BY di), 6) AS drawdown FROM (SELECT di, product(1 + r) OVER (ORDER BY di) AS eq FROM ls)", "ls")
def win_12(spark, d):
    p = P(spark, d)
    return M.drawdown(one(ls_returns(p, momentum(p)))).select("di", *r6("equity", "drawdown"))


@query("SELECT p.ticker, p.di, count(DISTINCT e.company) AS n FROM p LEFT JOIN (SELECT grades.ticker, company, min(cal.di) AS di FROM grades JOIN cal ON cal.date >= grades.date GROUP BY grades.ticker, company, o_orderkey) e ON e.ticker = p.ticker AND e.di BETWEEN p.di - 251 AND p.di GROUP BY 1, 2", "p grades")
def win_13(spark, d):
    p = P(spark, d)
    return W.trailing_distinct(A.on_calendar(S.grades(spark, d), p), p.select("ticker", "di"), "company", 252, "n")


@query(f"SELECT di, ticker, coalesce(last_value(dec IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY di ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 1 AS held FROM (SELECT di, ticker, CASE WHEN rk / n >= 0.8 THEN 1 WHEN rk / n >= 0.65 THEN NULL ELSE 0 END AS dec FROM {RANKED})", "mom")
def win_14(spark, d):
    return momentum(P(spark, d)).withColumn("pct", X.pct_rank("value")).select("di", "ticker", W.hysteresis("pct", 0.2, 0.35).alias("held"))


@query("SELECT di, ticker, CASE WHEN rn <= floor((n + 1) / 3.0) THEN 0 WHEN rn > n - ceil(n / 3.0) THEN 2 ELSE 1 END AS third FROM (SELECT di, ticker, row_number() OVER (PARTITION BY di ORDER BY value, ticker) AS rn, count(*) OVER (PARTITION BY di) AS n FROM mom)", "mom")
def win_17(spark, d):
    return momentum(P(spark, d)).select("di", "ticker", X.terciles("value").alias("third"))


@query("SELECT p.date, p.ticker, round(e.actual, 2) AS actual, e.date AS matched FROM p ASOF LEFT JOIN earn e ON p.ticker = e.ticker AND p.date >= e.date", "p earn")
def jn_03(spark, d):
    return A.asof(P(spark, d).select("date", "ticker"), S.earnings(spark, d), ["ticker"], "date", "date", ["actual"]).select("date", "ticker", F.round("actual", 2).alias("actual"), "matched")


@query("SELECT p.date, p.ticker, CASE WHEN date_diff('day', e.date, p.date) <= 45 THEN round(e.actual, 2) END AS actual FROM p ASOF LEFT JOIN earn e ON p.ticker = e.ticker AND p.date >= e.date", "p earn")
def jn_04(spark, d):
    return A.asof(P(spark, d).select("date", "ticker"), S.earnings(spark, d), ["ticker"], "date", "date", ["actual"], tolerance_days=45).select("date", "ticker", F.round("actual", 2).alias("actual"))


@query("SELECT p.date, p.ticker, round(e.actual, 2) AS actual FROM p ASOF LEFT JOIN earn e ON p.ticker = e.ticker AND p.date > e.date", "p earn")
def jn_05(spark, d):
    return A.asof(P(spark, d).select("date", "ticker"), S.earnings(spark, d), ["ticker"], "date", "date", ["actual"], inclusive=False).select("date", "ticker", F.round("actual", 2).alias("actual"))


@query("SELECT e.ticker, e.date, min(p.date) AS traded FROM earn e LEFT JOIN p ON p.ticker = e.ticker AND p.date BETWEEN e.date AND e.date + INTERVAL 14 DAY GROUP BY 1, 2", "p earn")
def jn_06(spark, d):
    days = P(spark, d).select("ticker", F.col("date").alias("day"))
    return A.asof(S.earnings(spark, d).select("ticker", "date"), days, ["ticker"], "date", "day", ["day"], direction="forward", tolerance_days=14).select("ticker", "date", F.col("day").alias("traded"))


@query("SELECT r.ticker, r.period, count(*) AS n FROM recs r JOIN grades g ON g.ticker = r.ticker AND g.date <= r.period AND date_diff('day', g.date, r.period) <= 90 GROUP BY 1, 2", "recs grades")
def jn_08(spark, d):
    found = A.window_items(S.recommendations(spark, d).select("ticker", "period"), S.grades(spark, d), ["ticker"], "period", "date", 90)
    return found.groupBy("ticker", "period").agg(F.count("*").alias("n"))


@query("SELECT ticker, period, company, date FROM (SELECT r.ticker, r.period, g.company, g.date, row_number() OVER (PARTITION BY r.ticker, r.period, g.company ORDER BY g.date DESC, g.o_orderkey DESC) AS rn FROM recs r JOIN grades g ON g.ticker = r.ticker AND g.date <= r.period) WHERE rn = 1", "recs grades")
def jn_09(spark, d):
    keys = S.recommendations(spark, d).select("ticker", "period")
    return A.latest(keys, S.grades(spark, d), ["ticker"], "period", "date", ["company"], ["o_orderkey"]).select("ticker", "period", "company", "date")


@query("SELECT ticker, period, company, date FROM (SELECT r.ticker, r.period, g.company, g.date, row_number() OVER (PARTITION BY r.ticker, r.period, g.company ORDER BY g.date DESC, g.o_orderkey DESC) AS rn FROM recs r JOIN grades g ON g.ticker = r.ticker AND g.date <= r.period) WHERE rn = 1", "recs grades")
def jn_09_all(spark, d):
    keys = S.recommendations(spark, d).select("ticker", "period")
    return A.latest(keys, S.grades(spark, d), ["ticker"], "period", "date", ["company"], ["o_orderkey"]).select("ticker", "period", "company", "date")


@query("SELECT y, src, dst, round(w, 6) AS w FROM edges", "edges")
def sig_08(spark, d):
    return cocoverage(S.grades(spark, d)).select("y", "src", "dst", *r6("w"))


def cocoverage(g: DataFrame) -> DataFrame:
    """(y, src, dst, w): names that shared a firm in the two years before y; a firm of n names adds 1/n. Each pair is made once, then mirrored."""
    x = g.select("date", "ticker", "company", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select((F.year("date") + F.col("k")).cast("long").alias("y"), "ticker", "company").distinct()
    n = F.count("*").over(Window.partitionBy("y", "company"))
    x = x.withColumn("w", 1.0 / n)
    half = PR.pairs(x, ["y", "company"], "ticker", ["w"]).groupBy("y", "a", "b").agg(F.sum("w").alias("w"))
    return PR.mirrored(half).withColumnsRenamed({"a": "src", "b": "dst"})


@query("SELECT ticker, period, round((2 * sb + b - s - 2 * ss) / nullif(sb + b + h + s + ss, 0)::DOUBLE, 6) AS score FROM recs", "recs")
def fn_08(spark, d):
    return S.recommendations(spark, d).select("ticker", "period", F.round(F.expr("(2 * sb + b - s - 2 * ss) / nullif(sb + b + h + s + ss, 0)"), 6).alias("score"))


@query("SELECT ticker, date, round((actual - estimate) / abs(estimate), 6) AS surprise FROM earn WHERE estimate IS NOT NULL AND estimate <> 0", "earn")
def fn_09(spark, d):
    return S.earnings(spark, d).where("estimate is not null and estimate <> 0").select("ticker", "date", F.round(F.expr("(actual - estimate) / abs(estimate)"), 6).alias("surprise"))


@query("SELECT di, ticker, round(value, 6) AS pead FROM (SELECT p.di, p.ticker, CASE WHEN date_diff('day', e.date, p.date) <= 90 THEN (e.actual - e.estimate) / abs(e.estimate) END AS value FROM p ASOF LEFT JOIN (SELECT * FROM earn WHERE estimate IS NOT NULL AND estimate <> 0) e ON p.ticker = e.ticker AND p.date >= e.date)", "p earn")
def sig_05(spark, d):
    e = S.earnings(spark, d).where("estimate is not null and estimate <> 0").withColumn("value", F.expr("(actual - estimate) / abs(estimate)"))
    return A.asof(P(spark, d).select("date", "di", "ticker"), e, ["ticker"], "date", "date", ["value"], tolerance_days=90).select("di", "ticker", F.round("value", 6).alias("pead"))


@query("SELECT di, ticker, round((CASE WHEN up THEN 0.5 / nullif(sum(up::INT) OVER w, 0) ELSE 0 END) - (CASE WHEN down THEN 0.5 / nullif(sum(down::INT) OVER w, 0) ELSE 0 END), 6) AS weight FROM legs WINDOW w AS (PARTITION BY di)", "legs")
def pf_06(spark, d):
    return quintile_weights(momentum(P(spark, d))).select("di", "ticker", *r6("weight"))


def quintile_weights(s: DataFrame) -> DataFrame:
    """s plus weight: half a unit over each leg, signed."""
    w = Window.partitionBy("di")
    part = lambda c: F.when(F.col(c), 0.5 / F.sum(F.col(c).cast("int")).over(w)).otherwise(0.0)
    return X.legs(s).withColumn("weight", part("up") - part("down"))


@query("SELECT date, ticker, round(1.0 / count(*) OVER (PARTITION BY date), 6) AS weight FROM p")
def pf_01(spark, d):
    return P(spark, d).select("date", "ticker", F.round(1.0 / F.count("*").over(Window.partitionBy("date")), 6).alias("weight"))


TURN = "w AS (SELECT di, ticker, (CASE WHEN up THEN 0.5 / sum(up::INT) OVER v ELSE 0 END) - (CASE WHEN down THEN 0.5 / sum(down::INT) OVER v ELSE 0 END) AS weight FROM legs WINDOW v AS (PARTITION BY di)), x AS (SELECT w.di + 1 AS di, w.ticker, w.weight * (1 + coalesce(f.fwd, 0)) AS drift FROM w LEFT JOIN fwd f ON f.di = w.di AND f.ticker = w.ticker), g AS (SELECT di, CASE WHEN sum(abs(drift)) = 0 THEN 1 ELSE sum(abs(drift)) END AS gross FROM x GROUP BY di), y AS (SELECT x.di, x.ticker, x.drift / g.gross AS drift FROM x JOIN g USING (di))"


@query(f"SELECT * FROM (WITH {TURN} SELECT di, round(0.5 * sum(abs(coalesce(w.weight, 0) - coalesce(y.drift, 0))), 6) AS turnover FROM w FULL JOIN y USING (di, ticker) WHERE di <= (SELECT max(di) FROM w) GROUP BY di)", "legs fwd")
def pf_10(spark, d):
    p = P(spark, d)
    return turnover(quintile_weights(momentum(p)), p).select("di", *r6("turnover"))


def turnover(w: DataFrame, p: DataFrame) -> DataFrame:
    """(di, turnover): half the distance from the weights before, drifted by returns and scaled back to gross 1."""
    last = w.agg(F.max("di").alias("last"))
    x = w.select("di", "ticker", "weight").join(forward(p), ["di", "ticker"], "left").select((F.col("di") + 1).alias("di"), "ticker", (F.col("weight") * (1 + F.coalesce("fwd", F.lit(0.0)))).alias("drift"))
    gross = F.sum(F.abs("drift")).over(Window.partitionBy("di"))
    x = x.withColumn("drift", F.col("drift") / F.when(gross == 0, 1.0).otherwise(gross))
    both = w.select("di", "ticker", "weight").join(x, ["di", "ticker"], "full").join(F.broadcast(last), F.col("di") <= F.col("last"))
    return both.groupBy("di").agg((0.5 * F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("drift", F.lit(0.0))))).alias("turnover"))


@query("SELECT di, ticker, round(0.5 * m / v, 6) AS raw, round(CASE WHEN n < 126 THEN 1 ELSE coalesce(greatest(0, least(1, 0.5 * m / nullif(v, 0))), 1) END, 6) AS exposure FROM (SELECT di, 'ls' AS ticker, avg(r) OVER w AS m, var_samp(r) OVER w AS v, count(r) OVER w AS n FROM ls WINDOW w AS (ORDER BY di ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING))".replace("round(0.5 * m / v, 6) AS raw, ", "").replace("di, ticker,", "di,", 1), "ls")
def rsk_03(spark, d):
    p = P(spark, d)
    return R.kelly(one(ls_returns(p, momentum(p))), n=126).select("di", *r6("exposure"))


def _streams(spark, d) -> DataFrame:
    own = OWN(spark, d).where("r is not null")
    ew = own.groupBy("di").agg(F.avg("r").alias("r")).select(F.lit("ew").alias("stream_id"), "di", "r")
    return own.select(F.col("ticker").cast("string").alias("stream_id"), "di", "r").unionByName(ew).unionByName(ew.select(F.lit("ew2").alias("stream_id"), "di", (2 * F.col("r")).alias("r")))


_CONTROL = """, st AS (SELECT ticker::VARCHAR AS stream_id, di, r FROM own WHERE r IS NOT NULL UNION ALL SELECT 'ew', di, avg(r) FROM own WHERE r IS NOT NULL GROUP BY di UNION ALL SELECT 'ew2', di, 2 * avg(r) FROM own WHERE r IS NOT NULL GROUP BY di),
    k AS (SELECT stream_id, di, -r AS loss, row_number() OVER (PARTITION BY stream_id ORDER BY di) AS k FROM st),
    b AS (SELECT k.*, lo, hi, greatest(hi - lo, 1e-6) AS scale FROM k JOIN (SELECT stream_id, quantile_cont(loss, 0.01) AS lo, quantile_cont(loss, 0.99) AS hi FROM k WHERE k <= 60 GROUP BY 1) USING (stream_id)),
    f(stream_id, alpha, gamma, k, di, c, q, x, exposure, realized) AS (
        SELECT stream_id, alpha::DOUBLE, gamma::DOUBLE, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 1::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT stream_id FROM st), (VALUES {grid}) g(alpha, gamma)
        UNION ALL
        SELECT stream_id, alpha, gamma, k, di, greatest(lo, least(hi, c - scale * g / (2 * sqrt(q + g * g)))), q + g * g, greatest(0, least(1, x - gamma * (c + greatest(over, 0) / (1 - 0.85) - alpha) / scale)), x, x * loss
        FROM (SELECT f.stream_id, alpha, gamma, b.k, b.di, c, q, x, loss, lo, hi, scale, x * loss - c AS over, 1 - CASE WHEN x * loss - c > 0 THEN 1 / (1 - 0.85) ELSE 0 END AS g FROM f JOIN b ON b.stream_id = f.stream_id AND b.k = f.k + 1))"""


def _control(grid: str, query: str) -> str:
    return S.with_sql("own", _CONTROL.format(grid=grid)).replace("WITH ", "WITH RECURSIVE ", 1) + " " + query


@query(_control("(0.005, 0.05)", "SELECT stream_id, alpha, gamma, di::INT AS di, round(exposure, 6) AS exposure, round(realized, 6) AS realized FROM f WHERE k > 0"), "")
def rsk_01(spark, d):
    grid = spark.createDataFrame([(0.005, 0.05)], "alpha double, gamma double")
    return R.controlled(_streams(spark, d), grid).select("stream_id", "alpha", "gamma", "di", *r6("exposure", "realized"))


@query(_control(", ".join(f"({a}, {g})" for a in (0.003, 0.005, 0.01) for g in (0.02, 0.05, 0.1)), "SELECT stream_id, alpha, gamma, round(avg(exposure), 6) AS exposure, round(avg(realized), 6) AS loss FROM f WHERE k > 0 GROUP BY 1, 2, 3"), "")
def rsk_05(spark, d):
    grid = spark.createDataFrame([(a, g) for a in (0.003, 0.005, 0.01) for g in (0.02, 0.05, 0.1)], "alpha double, gamma double")
    c = R.controlled(_streams(spark, d), grid)
    return c.groupBy("stream_id", "alpha", "gamma").agg(F.round(F.avg("exposure"), 6).alias("exposure"), F.round(F.avg("realized"), 6).alias("loss"))


@query(_control("(0.003, 0.05), (0.005, 0.05), (0.01, 0.05)", "SELECT stream_id, alpha, round(avg((exposure <= 0)::INT), 6) AS at_zero, round(avg((exposure >= 1)::INT), 6) AS at_one, round(max(realized), 6) AS worst FROM f WHERE k > 0 GROUP BY 1, 2"), "")
def rsk_04(spark, d):
    grid = spark.createDataFrame([(a, 0.05) for a in (0.003, 0.005, 0.01)], "alpha double, gamma double")
    c = R.controlled(_streams(spark, d), grid).groupBy("stream_id", "alpha")
    return c.agg(F.round(F.avg((F.col("exposure") <= 0).cast("int")), 6).alias("at_zero"), F.round(F.avg((F.col("exposure") >= 1).cast("int")), 6).alias("at_one"), F.round(F.max("realized"), 6).alias("worst"))


IC = "SELECT di, corr(a, b) AS ic FROM (SELECT mom.di, rank() OVER (PARTITION BY mom.di ORDER BY value) + (count(*) OVER (PARTITION BY mom.di, value) - 1) / 2.0 AS a, rank() OVER (PARTITION BY mom.di ORDER BY fwd) + (count(*) OVER (PARTITION BY mom.di, fwd) - 1) / 2.0 AS b FROM mom JOIN fwd ON mom.di = fwd.di AND mom.ticker = fwd.ticker) GROUP BY di HAVING count(*) >= 10"


def daily_ic(s: DataFrame, fwd: DataFrame, least: int = 10) -> DataFrame:
    """(di, ic): rank correlation by date, with enough names."""
    both = s.join(fwd, ["di", "ticker"]).select("di", X.average_rank("value").alias("a"), X.average_rank("fwd").alias("b"))
    return both.groupBy("di").agg(F.when(F.count("*") >= least, F.corr("a", "b")).alias("ic")).where("ic is not null")


@query(f"SELECT di, round(ic, 6) AS ic FROM ({IC})", "mom fwd")
def ic_01(spark, d):
    p = P(spark, d)
    return daily_ic(momentum(p), forward(p)).select("di", *r6("ic"))


@query("SELECT round(corr(a, b), 6) AS ic, count(*) AS n, round(1 / sqrt(count(*) - 3), 6) AS se FROM (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, rank() OVER (ORDER BY fwd) + (count(*) OVER (PARTITION BY fwd) - 1) / 2.0 AS b FROM mom JOIN fwd ON mom.di = fwd.di AND mom.ticker = fwd.ticker)", "mom fwd")
def ic_03(spark, d):
    p = P(spark, d)
    both = momentum(p).join(forward(p), ["di", "ticker"])
    return pooled_ic(both, "value", "fwd")


def pooled_ic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over all rows; both columns are ranked in one range-partitioned order of their distinct values."""
    ranked = O.average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), [a, b])
    return ranked.agg(F.round(F.corr(f"rank_{a}", f"rank_{b}"), 6).alias("ic"), F.count("*").alias("n"), F.round(1 / F.sqrt(F.count("*") - 3), 6).alias("se"))


@query("SELECT di, round(sum(CASE WHEN ticker % 2 = 0 THEN 1.0 END * fwd) / nullif(sum(CASE WHEN ticker % 2 = 0 AND fwd IS NOT NULL THEN 1.0 END), 0), 6) AS m FROM fwd GROUP BY di", "fwd")
def agg_09(spark, d):
    weight = F.when(F.col("ticker") % 2 == 0, 1.0)
    return forward(P(spark, d)).groupBy("di").agg(F.round(F.sum(weight * F.col("fwd")) / F.nullif(F.sum(F.when(F.col("fwd").isNotNull(), weight)), F.lit(0.0)), 6).alias("m"))


@query("SELECT year(date) AS y, ticker, count(*) AS n, round(avg(close), 6) AS mean, round(min(close), 6) AS low, round(max(close), 6) AS high FROM p GROUP BY 1, 2")
def agg_01(spark, d):
    return P(spark, d).groupBy(F.year("date").cast("long").alias("y"), "ticker").agg(F.count("*").alias("n"), F.avg("close").alias("mean"), F.min("close").alias("low"), F.max("close").alias("high")).select("y", "ticker", "n", *r6("mean", "low", "high"))


@query("SELECT di, round(quantile_cont(close, 0.1), 6) AS q10, round(quantile_cont(close, 0.5), 6) AS q50, round(quantile_cont(close, 0.9), 6) AS q90 FROM p GROUP BY di")
def agg_04(spark, d):
    q = P(spark, d).groupBy("di").agg(F.percentile("close", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("q"))
    return q.select("di", *(F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("q10", "q50", "q90"))))


@query("SELECT ticker, round(exp(sum(ln(1 + r))) - 1, 6) AS total FROM own WHERE r IS NOT NULL GROUP BY ticker", "own")
def agg_11(spark, d):
    return OWN(spark, d).where("r is not null").groupBy("ticker").agg(F.round(F.product(1 + F.col("r")) - 1, 6).alias("total"))


@query("SELECT a.ticker AS a, b.ticker AS b, round(corr(a.r, b.r), 6) AS c, round(covar_samp(a.r, b.r), 8) AS cov FROM own a JOIN own b ON a.di = b.di AND a.ticker < b.ticker WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2", "own")
def agg_07(spark, d):
    r = OWN(spark, d).where("r is not null").select("di", "ticker", "r")
    return r.alias("a").join(r.alias("b"), "di").where("a.ticker < b.ticker").groupBy(F.col("a.ticker").alias("a"), F.col("b.ticker").alias("b")).agg(F.round(F.corr("a.r", "b.r"), 6).alias("c"), F.round(F.covar_samp("a.r", "b.r"), 8).alias("cov"))


@query("SELECT ticker, count(*) FILTER (WHERE low > least(close, high) + 1e-6 OR high < close - 1e-6) AS broken, count(*) FILTER (WHERE abs(dl) > 0.5) AS jumps, round(count(close)::DOUBLE / (SELECT count(*) FROM cal), 6) AS coverage FROM (SELECT *, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY di)) AS dl FROM p) GROUP BY ticker")
def qc_01_03(spark, d):
    p = P(spark, d)
    days = p.select("date").distinct().agg(F.count("*").alias("days"))
    x = p.withColumn("dl", F.ln("close") - F.ln(W.shift_own("close", 1))).join(F.broadcast(days))
    broken = (F.col("low") > F.least("close", "high") + 1e-6) | (F.col("high") < F.col("close") - 1e-6)
    return x.groupBy("ticker").agg(F.count_if(broken).alias("broken"), F.count_if(F.abs("dl") > 0.5).alias("jumps"), F.round(F.count("close") / F.max("days"), 6).alias("coverage"))


@query("SELECT ticker, di, cls FROM (SELECT ticker, di, CASE WHEN value >= q[4] THEN 'STRONG_BUY' WHEN value >= q[3] THEN 'BUY' WHEN value >= q[2] THEN 'HOLD' WHEN value >= q[1] THEN 'SELL' ELSE 'STRONG_SELL' END AS cls FROM mom JOIN (SELECT ticker, quantile_cont(value, [0.03, 0.15, 0.53, 0.85]) AS q FROM mom GROUP BY ticker) USING (ticker))", "mom")
def lbl_02(spark, d):
    return labels(momentum(P(spark, d))).select("ticker", "di", "cls")


def labels(s: DataFrame, cuts=(0.03, 0.15, 0.53, 0.85)) -> DataFrame:
    """s plus cls: five classes by each ticker's own quantiles, borders in the upper class."""
    q = s.groupBy("ticker").agg(F.percentile("value", F.array(*map(F.lit, cuts))).alias("_q"))
    out = F.lit("STRONG_SELL")
    for k, name in enumerate(("SELL", "HOLD", "BUY", "STRONG_BUY")):
        out = F.when(F.col("value") >= F.col("_q")[k], name).otherwise(out)
    return s.join(q, "ticker").withColumn("cls", out).drop("_q")


@query("SELECT cls, cap FROM (SELECT cls, count(*) AS n, min(count(*)) OVER () AS lo FROM x GROUP BY cls), (SELECT n AS cap FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*)) AS k FROM x GROUP BY cls) WHERE k = 2)".replace("FROM x", "FROM (SELECT ticker, di, CASE WHEN value >= q[4] THEN 'STRONG_BUY' WHEN value >= q[3] THEN 'BUY' WHEN value >= q[2] THEN 'HOLD' WHEN value >= q[1] THEN 'SELL' ELSE 'STRONG_SELL' END AS cls FROM mom JOIN (SELECT ticker, quantile_cont(value, [0.03, 0.15, 0.53, 0.85]) AS q FROM mom GROUP BY ticker) USING (ticker))"), "mom")
def cor_02_caps(spark, d):
    x = labels(momentum(P(spark, d))).groupBy("cls").agg(F.count("*").alias("n"))
    cap = x.withColumn("k", F.row_number().over(Window.orderBy("n"))).where("k = 2").select(F.col("n").alias("cap"))  # five rows
    return x.crossJoin(F.broadcast(cap)).select("cls", "cap")
