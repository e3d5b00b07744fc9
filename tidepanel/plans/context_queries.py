"""Queries over what was known of a name at a time: rebalance dates, price snapshots, contexts of five kinds, the evaluation grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.text import abbreviated, abbreviated_sql
from tidepanel.operators import asof as A
from tidepanel.operators import context as C
from tidepanel.operators.release import correct_release_dates, enrich_insider
from tidepanel.sources import fixtures as S
from tidepanel.sources.files import stored

from . import corpus_queries, model_queries
from .corpus_queries import NEWS, news
from .panel_queries import P
from .product_queries import classes, signal
from .table_queries import _SERIES, _TEXT

QUERIES: dict = {}
ORACLE: dict = {}

#: Orders and the panel lie 23 years before the news; months between.
SHIFT = 276


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------- rebalance dates


def fridays(spark, start: str, end: str) -> DataFrame:
    """(anchor): the Fridays from start to end."""
    first = F.next_day(F.date_sub(F.to_date(F.lit(start)), 1), "FRI")
    return spark.range(1).select(F.explode(F.sequence(first, F.to_date(F.lit(end)), F.expr("interval 7 days"))).alias("anchor"))


def rebalance_days(spark, p: DataFrame, start: str, end: str) -> DataFrame:
    """(date): for each Friday the last trading day at or before it, but none before start; each once."""
    days = p.select(F.lit(1).alias("all"), "date").distinct()
    got = A.asof(fridays(spark, start, end).withColumn("all", F.lit(1)), days, ["all"], "anchor", "date", ["date"])
    return got.where(F.col("date") >= F.to_date(F.lit(start))).select("date").distinct()


START, END = "1998-01-01", "1999-12-31"
_FRIDAYS = "SELECT unnest(generate_series(DATE '{0}' + CAST((5 - isodow(DATE '{0}') + 7) % 7 AS INT), DATE '{1}', INTERVAL 7 DAY))::DATE AS anchor"
REBALANCE = f"(SELECT DISTINCT date FROM (SELECT max(date) AS date FROM ({_FRIDAYS.format(START, END)}) JOIN (SELECT DISTINCT date FROM p) ON date <= anchor GROUP BY anchor) WHERE date >= DATE '{START}')"


@query(S.with_sql("p", f"SELECT date AS anchor FROM {REBALANCE}"))
def win_16(spark, d):
    return rebalance_days(spark, P(spark, d), START, END).select(F.col("date").alias("anchor"))


# ------------------------------------------------------------ price snapshots

#: The names of the indicators in a snapshot, in order, with their columns in ind_01 and ind_01_rest.
INDICATORS = {"close_50_sma": "sma50", "close_200_sma": "sma200", "close_10_ema": "ema10", "macd": "macd", "macds": "macd_signal", "macdh": "macd_hist", "rsi_14": "rsi14", "kdjk": "kdj_k", "cci": "cci", "close_10_roc": "roc10", "atr": "atr", "boll": "boll_mid", "boll_ub": "boll_up", "boll_lb": "boll_low", "dx": "dx", "mfi": "mfi"}
BARS = 15


def panel(spark, d) -> DataFrame:
    """The panel, stored, since bars and indicators each read it."""
    return stored(P(spark, d), "panel")


def all_indicators(p: DataFrame) -> DataFrame:
    return corpus_queries.indicators(p).join(model_queries.more_indicators(p), ["ticker", "di"])


def priced(p: DataFrame) -> DataFrame:
    """(ticker, date, bars, found): at each bar the last 15 bars as lines of text and the indicators of the day."""
    w = Window.partitionBy("ticker").orderBy("di")
    bar = F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" | "), F.array_join(F.array(*(abbreviated(F.col(c).cast("double")) for c in ("open", "high", "low", "close", "volume"))), " "))
    lines = p.select("ticker", "di", "date", F.collect_list(bar).over(w.rowsBetween(1 - BARS, 0)).alias("bars"))
    x = lines.join(all_indicators(p), ["ticker", "di"])
    found = F.array(*(F.concat(F.lit(f"  {name}: "), abbreviated(F.col(c))) for name, c in INDICATORS.items()))
    return x.select("ticker", "date", "bars", found.alias("found"))


def snapshots(asked: DataFrame, bars: DataFrame) -> DataFrame:
    """asked (ticker, as_of) plus snapshot: the bars and indicators of the last trading day at or before as_of, or that there is no data."""
    got = A.asof(asked, bars, ["ticker"], "as_of", "date", ["bars", "found"])
    day = F.date_format("as_of", "yyyy-MM-dd")
    head = F.array(F.concat(F.lit("Ticker: "), F.col("ticker").cast("string")), F.concat(F.lit("As of: "), day, F.lit(" (showing last "), F.size("bars").cast("string"), F.lit(" trading days)")), F.lit(""), F.lit("Date | Open High Low Close Volume"))
    text = F.array_join(F.concat(head, F.col("bars"), F.array(F.lit(""), F.lit("Indicators (latest):")), F.col("found")), "\n")
    none = F.concat(F.lit("Ticker "), F.col("ticker").cast("string"), F.lit(" as of "), day, F.lit(": no data."))
    return got.select(*asked.columns, F.when(F.col("bars").isNull(), none).otherwise(text).alias("snapshot"))


_BAR = "strftime(date, '%Y-%m-%d') || ' | ' || " + " || ' ' || ".join(abbreviated_sql(f"{c}::DOUBLE") for c in ("open", "high", "low", "close", "volume"))
_FOUND = " || chr(10) || ".join(f"'  {name}: ' || {abbreviated_sql(c)}" for name, c in INDICATORS.items())
#: The first price of a week in SQL with the ties that the fixture breaks.
_OPEN = "(SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, s_nationkey AS ticker, arg_min(l_extendedprice / l_quantity, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_quantity, 'g': l_extendedprice}) AS open FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


def snapshot_sql(asked: str) -> str:
    """SQL for the snapshots of asked (ticker, as_of), to stand behind the tables of `p`."""
    bars = f"(SELECT ticker, di, date, string_agg(line, chr(10)) OVER w AS bars, count(*) OVER w AS n FROM (SELECT ticker, di, date, {_BAR} AS line FROM (SELECT p.*, o.open FROM p JOIN {_OPEN} o USING (date, ticker))) WINDOW w AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 14 PRECEDING AND CURRENT ROW))"
    rows = f"(SELECT ticker, date, bars, n, {_FOUND} AS found FROM {bars} JOIN ({corpus_queries.ORACLE['ind_01']}) USING (ticker, di) JOIN ({model_queries.ORACLE['ind_01_rest']}) USING (ticker, di))"
    return f"(SELECT a.*, CASE WHEN bars IS NULL THEN 'Ticker ' || a.ticker || ' as of ' || strftime(a.as_of, '%Y-%m-%d') || ': no data.' ELSE 'Ticker: ' || a.ticker || chr(10) || 'As of: ' || strftime(a.as_of, '%Y-%m-%d') || ' (showing last ' || n || ' trading days)' || chr(10) || chr(10) || 'Date | Open High Low Close Volume' || chr(10) || bars || chr(10) || chr(10) || 'Indicators (latest):' || chr(10) || found END AS snapshot FROM {asked} a ASOF LEFT JOIN {rows} b ON a.ticker = b.ticker AND a.as_of >= b.date)"


_ASKED_PRICES = f"(SELECT n_nationkey AS ticker, anchor AS as_of FROM nation, ({_FRIDAYS.format('1994-12-16', '1995-12-29')}))"


@query(S.with_sql("p", f"SELECT ticker, as_of, snapshot, left(sha1(snapshot), 12) AS hash FROM {snapshot_sql(_ASKED_PRICES)}"))
def ctx_02(spark, d):
    """Every nation on every Friday of a year and the weeks before the first bar."""
    asked = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("ticker")).crossJoin(F.broadcast(fridays(spark, "1994-12-16", "1995-12-29"))).withColumnRenamed("anchor", "as_of")  # a row a week
    return snapshots(asked, priced(panel(spark, d))).withColumn("hash", F.substring(F.sha1("snapshot"), 1, 12))


# -------------------------------------------------------------------- contexts


def month_shifted(c: str) -> Column:
    return F.add_months(F.to_date(c), SHIFT)


def items(spark, d, with_summary: bool = False) -> DataFrame:
    """(name, key, kind, ts, tie, item): a line of text for each item of the five kinds, with the time from which it was known.

    The forms of the lines are fixed values.
    """
    t = lambda n: S.table(spark, d, n)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    none, text = F.lit(""), F.translate(F.coalesce("text", F.lit("")), "\n\r\t", "   ")
    line = F.concat(F.lit("  "), day("ts"), F.lit(" | "), F.substring(text, 1, 80), F.lit(" ("), F.coalesce("source", none), F.lit(")"))
    if with_summary:
        body = F.trim(F.substring(text, 81, 120))
        line = F.concat(line, F.when(body != "", F.concat(F.lit("\n      "), body)).otherwise(none))
    told = news(spark, d).select("doc_id", "ticker", "ts").join(t("documents").select("doc_id", "text", "source"), "doc_id")
    out = told.select(F.col("ticker").cast("string").alias("name"), none.alias("key"), F.lit("news").alias("kind"), "ts", F.col("doc_id").alias("tie"), line.alias("item"))

    orders = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    quarter = F.to_date(F.date_trunc("quarter", month_shifted("o_orderdate")))
    filed = orders.groupBy(F.col("c_nationkey").alias("n"), F.col("o_orderpriority").alias("key"), quarter.alias("q")).agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100).alias("v"))
    filed = filed.withColumn("on", F.date_add(F.add_months("q", 3), F.col("n") + 19))
    line = F.concat(F.lit("  "), F.col("key"), F.lit(": "), abbreviated(F.col("v")), F.when(F.quarter("q") == 4, " (10-K, filed ").otherwise(" (10-Q, filed "), day("on"), F.lit(")"))
    out = out.unionByName(filed.select(F.col("n").cast("string").alias("name"), "key", F.lit("fundamental").alias("kind"), F.col("on").cast("timestamp_ntz").alias("ts"), F.unix_date("q").cast("long").alias("tie"), line.alias("item")))

    graded = orders.withColumn("on", month_shifted("o_orderdate"))
    line = F.concat(F.lit("  analyst "), day("on"), F.lit(": firm "), (F.col("o_custkey") % 40).cast("string"), F.lit(" "), F.when(F.col("o_orderkey") % 5 == 0, "?").otherwise(F.col("o_orderpriority")), F.lit("->"), F.col("o_orderstatus"), F.lit(" ("), F.when(F.col("o_orderstatus") == "F", "up").when(F.col("o_orderstatus") == "O", "down").otherwise("init"), F.lit(")"))
    out = out.unionByName(graded.select(F.col("c_nationkey").cast("string").alias("name"), none.alias("key"), F.lit("analyst").alias("kind"), F.col("on").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("tie"), line.alias("item")))

    traded = enrich_insider(t("events").withColumn("text", F.expr(_TEXT)))
    line = F.concat(F.lit("  insider "), day("ts"), F.lit(": "), F.col("txn_type"), F.lit(" "), abbreviated(F.round(F.col("value") * 100).cast("long").cast("double")), F.lit(" sh ["), F.col("direction"), F.lit("]"))
    out = out.unionByName(traded.select((F.col("user_id") % 25).cast("string").alias("name"), none.alias("key"), F.lit("insider").alias("kind"), F.to_date("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("tie"), line.alias("item")))

    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("v")
    shifted = t("orders").withColumn("on", month_shifted("o_orderdate"))
    monthly = shifted.groupBy(F.expr(_SERIES).alias("series"), F.trunc("on", "month").alias("date")).agg(cents)
    macro = correct_release_dates(monthly.unionByName(shifted.groupBy(F.lit("DAILY").alias("series"), F.col("on").alias("date")).agg(cents)))
    line = F.concat(F.lit("  "), F.col("series"), F.lit(": "), F.format_string("%.2f", F.col("v") / 1e8 + 1e-9), F.lit(" (ref "), day("date"), F.lit(")"))
    return out.unionByName(macro.select(F.lit("*").alias("name"), F.col("series").alias("key"), F.lit("macro").alias("kind"), F.col("release_date").cast("timestamp_ntz").alias("ts"), F.unix_date("date").cast("long").alias("tie"), line.alias("item")))


_D = f"CAST(o_orderdate + INTERVAL {SHIFT} MONTH AS DATE)"
_SUMMED = "sum(round(o_totalprice * 100)::BIGINT)"
_DUE = "CASE series WHEN 'DAILY' THEN date + 1 ELSE CAST(date + INTERVAL 1 MONTH AS DATE) + CASE series WHEN 'FEDFUNDS' THEN 2 WHEN 'UNRATE' THEN 7 ELSE 14 END END"


def items_sql(with_summary: bool = False) -> str:
    """The tables news and items, to stand in a WITH."""
    text = "translate(coalesce(text, ''), chr(10) || chr(13) || chr(9), '   ')"
    more = f" || CASE WHEN trim(substr({text}, 81, 120), ' ') <> '' THEN chr(10) || '      ' || trim(substr({text}, 81, 120), ' ') ELSE '' END" if with_summary else ""
    line = f"'  ' || strftime(ts, '%Y-%m-%d') || ' | ' || substr({text}, 1, 80) || ' (' || coalesce(source, '') || ')'{more}"
    insider = "CASE event_type WHEN 'click' THEN 'SALE' WHEN 'view' THEN 'GRANT' WHEN 'signup' THEN 'GIFT' WHEN 'error' THEN 'EXERCISE' ELSE 'PURCHASE' END"
    way = "CASE event_type WHEN 'click' THEN 'SELL' WHEN 'purchase' THEN 'BUY' ELSE 'NEUTRAL' END"
    return f"""{NEWS}, items AS (
        SELECT n.ticker::VARCHAR AS name, '' AS key, 'news' AS kind, ts, n.doc_id AS tie, {line} AS item FROM news n JOIN documents d ON n.doc_id = d.doc_id
        UNION ALL SELECT n::VARCHAR, key, 'fundamental', filed::TIMESTAMP, q - DATE '1970-01-01', '  ' || key || ': ' || {abbreviated_sql('v')} || CASE WHEN quarter(q) = 4 THEN ' (10-K, filed ' ELSE ' (10-Q, filed ' END || strftime(filed, '%Y-%m-%d') || ')' FROM (
            SELECT *, CAST(q + INTERVAL 3 MONTH AS DATE) + n + 19 AS filed FROM (SELECT c_nationkey AS n, o_orderpriority AS key, CAST(date_trunc('quarter', {_D}) AS DATE) AS q, {_SUMMED} / 100 AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3))
        UNION ALL SELECT c_nationkey::VARCHAR, '', 'analyst', {_D}::TIMESTAMP, o_orderkey, '  analyst ' || strftime({_D}, '%Y-%m-%d') || ': firm ' || o_custkey % 40 || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '?' ELSE o_orderpriority END || '->' || o_orderstatus || ' (' || CASE o_orderstatus WHEN 'F' THEN 'up' WHEN 'O' THEN 'down' ELSE 'init' END || ')' FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT (user_id % 25)::VARCHAR, '', 'insider', date_trunc('day', ts), event_id, '  insider ' || strftime(ts, '%Y-%m-%d') || ': ' || {insider} || ' ' || {abbreviated_sql('(round(value * 100)::BIGINT)::DOUBLE')} || ' sh [' || {way} || ']' FROM events
        UNION ALL SELECT '*', series, 'macro', (CASE isodow(due) WHEN 6 THEN due + 2 WHEN 7 THEN due + 1 ELSE due END)::TIMESTAMP, date - DATE '1970-01-01', '  ' || series || ': ' || printf('%.2f', v / 1e8 + 1e-9) || ' (ref ' || strftime(date, '%Y-%m-%d') || ')' FROM (SELECT *, {_DUE} AS due FROM (
            SELECT {_SERIES} AS series, CAST(date_trunc('month', {_D}) AS DATE) AS date, {_SUMMED} AS v FROM orders GROUP BY 1, 2 UNION ALL SELECT 'DAILY', {_D}, {_SUMMED} FROM orders GROUP BY 2)))"""


def context_sql(asked: str, rich: bool = False) -> str:
    """SQL for the contexts of asked (ticker, as_of), behind the table items."""
    span = "INTERVAL 60 DAY" if rich else "INTERVAL 30 DAY"
    bucket = "0" if rich else "CASE WHEN kind <> 'news' OR ts > as_of - INTERVAL 4 DAY THEN 0 WHEN ts > as_of - INTERVAL 11 DAY THEN 1 ELSE 2 END"
    cap = "CASE kind WHEN 'news' THEN " + ("1000000000" if rich else "CASE bucket WHEN 0 THEN 10 ELSE 20 END") + " WHEN 'analyst' THEN 12 WHEN 'insider' THEN 12 ELSE 1 END"
    rows = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of, kind, key, bucket ORDER BY ts DESC, tie DESC) AS k FROM (SELECT a.ticker, a.as_of, i.*, {bucket} AS bucket FROM {asked} a JOIN items i ON i.name IN (a.ticker, '*') AND i.ts <= a.as_of AND (kind IN ('fundamental', 'macro') OR i.ts >= a.as_of - CASE kind WHEN 'news' THEN {span} ELSE INTERVAL 90 DAY END))) WHERE k <= {cap})"
    lines = lambda kind, more="": f"string_agg(item, chr(10) ORDER BY bucket, key, k) FILTER (kind = '{kind}'{more})"
    told = lines("news") if rich else "nullif(concat_ws(chr(10), " + ", ".join(f"'  [{tag}]' || chr(10) || " + lines("news", f" AND bucket = {k}") for k, tag in enumerate(("≤3d", "4-10d", "11-30d"))) + "), '')"
    parts = [("NEWS (last 60d)" if rich else "NEWS (last 30d)", told), ("FUNDAMENTALS (latest filed)", lines("fundamental")), ("SENTIMENT", f"nullif(concat_ws(chr(10), {lines('analyst')}, {lines('insider')}), '')"), ("MACRO (latest)", lines("macro"))]
    text = " || chr(10) || ".join(f"'=== {title} ===' || chr(10) || coalesce({x}, '  none')" for title, x in parts)
    return f"(SELECT a.ticker, a.as_of, {text} AS context FROM {asked} a LEFT JOIN {rows} r USING (ticker, as_of) GROUP BY 1, 2)"


_ASKED = "(SELECT DISTINCT ticker::VARCHAR AS ticker, date_trunc('day', ts) + INTERVAL 1 DAY AS as_of FROM news)"


def asked_news(spark, d) -> DataFrame:
    """(ticker, as_of): the midnight after each day with news of a name."""
    return news(spark, d).select("ticker", (F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1))).alias("as_of")).distinct()


@query(f"WITH {items_sql()} SELECT * FROM {context_sql(_ASKED)}")
def ctx_01(spark, d):
    return C.sections(asked_news(spark, d), items(spark, d))


@query(f"WITH {items_sql(True)} SELECT * FROM {context_sql(_ASKED, True)}")
def ctx_01_rich(spark, d):
    """All headlines of 60 days, with what follows them."""
    return C.sections(asked_news(spark, d), items(spark, d, True), rich=True)


@query(f"WITH {items_sql()} SELECT ticker, as_of, bucket, tie AS doc_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of, bucket ORDER BY ts DESC, tie DESC) AS k FROM (SELECT a.ticker, a.as_of, i.ts, i.tie, CASE WHEN ts > as_of - INTERVAL 4 DAY THEN 0 WHEN ts > as_of - INTERVAL 11 DAY THEN 1 ELSE 2 END AS bucket FROM {_ASKED} a JOIN items i ON i.name = a.ticker AND kind = 'news' AND i.ts <= a.as_of AND i.ts >= a.as_of - INTERVAL 30 DAY)) WHERE k <= CASE bucket WHEN 0 THEN 10 ELSE 20 END")
def top_03(spark, d):
    asked = asked_news(spark, d).select(F.col("ticker").cast("string").alias("name"), F.lit("").alias("key"), F.lit("news").alias("kind"), "as_of")
    told = news(spark, d).select(F.col("ticker").cast("string").alias("name"), F.lit("").alias("key"), F.lit("news").alias("kind"), "ts", F.col("doc_id").alias("tie"), F.col("doc_id").alias("item"))
    return C.newest(asked, told, {"news": C.NEWS}).select(F.col("name").alias("ticker"), "as_of", "bucket", F.col("item").alias("doc_id"), (F.col("back") + 1).cast("int").alias("k"))


# ------------------------------------------------------------- evaluation grid

#: Points of the grid that are drawn, and the seed.
POINTS, SEED = 200, "42"
_INSTRUCTION = "Read what was known and choose one of: STRONG_BUY, BUY, HOLD, SELL, STRONG_SELL. End with the choice in triple brackets, for example [[[BUY]]]."
_GRID = f"(SELECT ticker, date, signal FROM sig JOIN {REBALANCE} USING (date) WHERE signal IS NOT NULL ORDER BY md5(ticker || '|' || strftime(date, '%Y-%m-%d') || '|{SEED}'), ticker, date LIMIT {POINTS})"


def evaluation_grid(spark, p: DataFrame) -> DataFrame:
    """(ticker, date, signal): names on rebalance days where the truth is defined; a seeded sample of them."""
    grid = signal(p).where("signal is not null").join(rebalance_days(spark, p, START, END), "date")
    draw = F.md5(F.concat_ws("|", F.col("ticker").cast("string"), F.date_format("date", "yyyy-MM-dd"), F.lit(SEED)))
    return grid.orderBy(draw, "ticker", "date").limit(POINTS).select("ticker", "date", "signal")


@query(S.with_sql("sig", f", {items_sql()}, grid AS {_GRID} SELECT g.ticker, strftime(g.date, '%Y-%m-%d') AS as_of, round(g.signal, 6) AS signal, '{_INSTRUCTION}' || chr(10) || chr(10) || s.snapshot AS price_only, '{_INSTRUCTION}' || chr(10) || chr(10) || s.snapshot || chr(10) || chr(10) || c.context AS multimodal FROM grid g JOIN {snapshot_sql('(SELECT ticker, date AS as_of FROM grid)')} s ON s.ticker = g.ticker AND s.as_of = g.date JOIN {context_sql(f'(SELECT ticker::VARCHAR AS ticker, date + INTERVAL {SHIFT} MONTH AS as_of FROM grid)')} c ON c.ticker = g.ticker::VARCHAR AND c.as_of = g.date + INTERVAL {SHIFT} MONTH WHERE NOT contains(s.snapshot, 'no data')").replace(") , news", "), news", 1))
def ctx_03(spark, d):
    """Points of the grid with their truth and both prompts: prices alone, and with what was known then."""
    p = panel(spark, d)
    grid = stored(evaluation_grid(spark, p), "grid")
    shots = stored(snapshots(grid.select("ticker", F.col("date").alias("as_of")), priced(p)).where(~F.col("snapshot").contains("no data")), "shots")
    then = F.add_months("as_of", SHIFT).cast("timestamp_ntz")
    known = C.sections(shots.select("ticker", then.alias("as_of")), items(spark, d)).select(F.col("ticker").alias("name"), F.col("as_of").alias("then"), "context")
    head = F.lit(_INSTRUCTION + "\n\n")
    both = grid.join(shots.withColumnRenamed("as_of", "date"), ["ticker", "date"]).join(known, (F.col("ticker").cast("string") == F.col("name")) & (F.add_months("date", SHIFT).cast("timestamp_ntz") == F.col("then")))
    return both.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("as_of"), F.round("signal", 6).alias("signal"), F.concat(head, "snapshot").alias("price_only"), F.concat(head, "snapshot", F.lit("\n\n"), "context").alias("multimodal"))


# ------------------------------------------------------------------ completions

#: Openers of completions, and the tone and action of each class.
OPENERS = ("Looking at the tape,", "On balance,", "In short,")
TONES = {"STRONG_SELL": ("decidedly negative", "an exit"), "SELL": ("negative", "a cut"), "HOLD": ("mixed", "no change"), "BUY": ("positive", "an addition"), "STRONG_BUY": ("decidedly positive", "a full position")}
_HEX = "CAST(list_sum(list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', h[i]) - 1)) AS BIGINT) % 3"
_TONE, _ACT = ("CASE cls " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in TONES.items()) + " END" for i in (0, 1))
_BODY = f"' the trend is ' || {_TONE} || ': the price stands at its means of 50 and 200 rows (' || {abbreviated_sql('sma50')} || ', ' || {abbreviated_sql('sma200')} || '), RSI(14) is ' || {abbreviated_sql('rsi14')} || ' and MACD ' || {abbreviated_sql('macd')} || '. That asks for ' || {_ACT} || '.' || chr(10) || chr(10) || '[[[' || cls || ']]]'"


@query(S.with_sql("lab", f"SELECT ticker, di, CASE {_HEX} WHEN 0 THEN '{OPENERS[0]}' WHEN 1 THEN '{OPENERS[1]}' ELSE '{OPENERS[2]}' END || {_BODY} AS completion FROM (SELECT lab.*, sma50, rsi14, sma200, macd, sha1(lab.ticker || '|' || lab.di) AS h FROM lab JOIN ({corpus_queries.ORACLE['ind_01']}) a USING (ticker, di) JOIN ({model_queries.ORACLE['ind_01_rest']}) b USING (ticker, di))"))
def cor_04(spark, d):
    """A completion for each label, grounded in the day's indicators; a hash of the key chooses the opener."""
    p = panel(spark, d)
    x = classes(signal(p)).join(all_indicators(p), ["ticker", "di"])
    # 16 = 1 (mod 3), so the number's remainder is that of the sum of its hex digits
    x = x.withColumn("h", F.sha1(F.concat_ws("|", "ticker", "di"))).withColumn("k", F.expr("aggregate(sequence(1, 40), 0, (t, i) -> t + locate(substr(h, i, 1), '0123456789abcdef') - 1) % 3 + 1"))
    told = lambda i: F.element_at(F.create_map(*(F.lit(y) for k, v in TONES.items() for y in (k, v[i]))), F.col("cls"))
    n = lambda c: abbreviated(F.col(c))
    text = F.concat(F.element_at(F.array(*map(F.lit, OPENERS)), F.col("k").cast("int")), F.lit(" the trend is "), told(0), F.lit(": the price stands at its means of 50 and 200 rows ("), n("sma50"), F.lit(", "), n("sma200"), F.lit("), RSI(14) is "), n("rsi14"), F.lit(" and MACD "), n("macd"), F.lit(". That asks for "), told(1), F.lit(".\n\n[[["), "cls", F.lit("]]]"))
    return x.select("ticker", "di", text.alias("completion"))
