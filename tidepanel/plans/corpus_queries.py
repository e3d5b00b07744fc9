"""Queries over decisions, texts and events: scalar functions, point-in-time contexts, corpus rules, rewards and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.text import abbreviated
from tidepanel.operators import asof as A
from tidepanel.operators import band as B
from tidepanel.operators import order as O
from tidepanel.operators import windows as W
from tidepanel.sources import files
from tidepanel.sources import fixtures as S

from .panel_queries import P
from .product_queries import BETS, CLASSES, INVALID, REWARD_ROWS, classes, rewards, signal
from .table_queries import DEC, TAG, tagged

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, d) -> DataFrame:
    return S.table(spark, d, "documents")


# --------------------------------------------------------- scalar functions


@query("SELECT o_orderkey, CASE WHEN x IS NULL THEN 'na' WHEN abs(x) >= 1e9 THEN printf('%.2fb', x / 1e9 + 1e-9) WHEN abs(x) >= 1e6 THEN printf('%.2fm', x / 1e6 + 1e-9) WHEN abs(x) >= 1e3 THEN printf('%.2fk', x / 1e3 + 1e-9) ELSE printf('%.2f', x + 1e-9) END AS short FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE floor(o_totalprice) * pow(10, o_orderkey % 5) / 100 END AS x FROM orders)")
def fn_02(spark, d):
    x = F.when(F.col("o_orderkey") % 7 != 0, F.floor("o_totalprice") * F.pow(F.lit(10), F.col("o_orderkey") % 5) / 100)
    return S.table(spark, d, "orders").select("o_orderkey", abbreviated(x).alias("short"))


@query("SELECT o_orderkey, CAST(CASE WHEN isodow(x) >= 6 THEN x + INTERVAL (8 - isodow(x)) DAY ELSE x END AS DATE) AS rolled, CAST(x + INTERVAL (CASE isodow(x) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END) DAY AS DATE) AS next FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS x FROM orders)")
def fn_06_days(spark, d):
    x, k = F.to_date("o_orderdate"), F.weekday("o_orderdate")
    return S.table(spark, d, "orders").select("o_orderkey", F.when(k >= 5, F.date_add(x, 7 - k)).otherwise(x).alias("rolled"), F.date_add(x, F.when(k == 4, 3).when(k == 5, 2).otherwise(1)).alias("next"))


def eastern(seconds: Column) -> Column:
    """The US Eastern time of seconds since 1970."""
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), "America/New_York")


#: Daylight saving of the US since 2007, as hours of UTC: from the second Sunday of March to the first of November.
_DST = "ts >= make_date(year(ts), 3, 1) + (7 + (7 - isodow(make_date(year(ts), 3, 1))) % 7)::INT + INTERVAL 7 HOUR AND ts < make_date(year(ts), 11, 1) + ((7 - isodow(make_date(year(ts), 11, 1))) % 7)::INT + INTERVAL 6 HOUR"


@query(f"SELECT event_id, CAST(local AS DATE) AS local_day, CAST(local + INTERVAL 8 HOUR AS DATE) AS counts_for FROM (SELECT event_id, date_trunc('second', ts) - CASE WHEN {_DST} THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS local FROM (SELECT event_id, ts + INTERVAL (event_id % 12) MONTH AS ts FROM events))")
def fn_07(spark, d):
    """Event times, moved over the months of a year, in US Eastern time; from 16:00 on they count for the next day."""
    moved = F.col("ts").cast("timestamp") + F.make_ym_interval(months=(F.col("event_id") % 12).cast("int"))
    local = eastern(F.unix_seconds(moved))
    return S.table(spark, d, "events").select("event_id", F.to_date(local).alias("local_day"), F.date_add(F.to_date(local), F.when(F.hour(local) >= 16, 1).otherwise(0)).alias("counts_for"))


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))"


@query(f"SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(a.w || b.w)), 1)::DOUBLE, 6) AS jaccard FROM (SELECT doc_id, {_WORDS} AS w FROM documents) a JOIN (SELECT doc_id, {_WORDS} AS w FROM documents) b ON b.doc_id = a.doc_id + 1")
def fn_12_jaccard(spark, d):
    x = docs(spark, d).select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))).alias("w"))
    two = x.select(F.col("doc_id").alias("a"), "w").join(x.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("w").alias("v")), "a")
    return two.select("a", "b", F.round(F.size(F.array_intersect("w", "v")) / F.greatest(F.size(F.array_union("w", "v")), F.lit(1)), 6).alias("jaccard"))


@query("SELECT conv_id, len(m)::INT AS turns, m[1].role AS first_role, md5(coalesce(m[1].text, '')) AS first, md5(coalesce(m[2].text, '')) AS second FROM (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)")
def fn_14_messages(spark, d):
    turns = S.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    text = lambda k: F.md5(F.coalesce(F.get("m", F.lit(k))["text"], F.lit(""))).alias(("first", "second")[k])
    return turns.select("conv_id", F.size("m").alias("turns"), F.get("m", F.lit(0))["role"].alias("first_role"), text(0), text(1))


@query("SELECT label, n, round(ic, 6) AS ic, round(-0.5 * ln(1 - ic * ic), 6) AS mi, round(tanh(atanh(ic) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(ic) + 1.96 / sqrt(n - 3)), 6) AS high, round(ic * sqrt((n - 2) / (1 - ic * ic)), 4) AS t FROM (SELECT p_size AS label, count(*) AS n, corr(p_partkey, p_retailprice) AS ic FROM part GROUP BY 1 HAVING count(*) > 10)")
def fn_16(spark, d):
    g = S.table(spark, d, "part").groupBy(F.col("p_size").alias("label")).agg(F.count("*").alias("n"), F.corr(F.col("p_partkey").cast("double"), "p_retailprice").alias("ic")).where("n > 10")
    ic, half = F.col("ic"), 1.96 / F.sqrt(F.col("n") - 3)
    return g.select("label", "n", F.round(ic, 6).alias("ic"), F.round(-0.5 * F.ln(1 - ic * ic), 6).alias("mi"), F.round(F.tanh(F.atanh(ic) - half), 6).alias("low"), F.round(F.tanh(F.atanh(ic) + half), 6).alias("high"), F.round(ic * F.sqrt((F.col("n") - 2) / (1 - ic * ic)), 4).alias("t"))


# ------------------------------------------------- reshaping, sampling, sets

#: Symbols that go by another name, and symbols left out.
RENAME, SKIP = {"FRANCE": "FRA", "GERMANY": "DEU"}, ("CHINA", "BRAZIL")


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FRA' WHEN 'GERMANY' THEN 'DEU' ELSE translate(n_name, ' .', '--') END AS symbol FROM nation WHERE n_name NOT IN ('CHINA', 'BRAZIL')")
def prj_09(spark, d):
    known = F.create_map(*(F.lit(x) for kv in RENAME.items() for x in kv))
    x = S.table(spark, d, "nation").where(~F.col("n_name").isin(*SKIP))
    return x.select("n_nationkey", F.coalesce(F.try_element_at(known, F.col("n_name")), F.translate("n_name", " .", "--")).alias("symbol"))


@query("SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || '7'), c_custkey LIMIT 50")
def prj_08(spark, d):
    """A seeded sample of 50 rows: those with the smallest hash of key and seed, so the same on every cluster."""
    return S.table(spark, d, "customer").select("c_custkey").orderBy(F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("7"))), "c_custkey").limit(50)


@query("SELECT user_id, event_type, sum(value) AS total FROM (SELECT user_id, event_type, value FROM events) GROUP BY 1, 2".replace("sum(value)", "round(sum(value), 4)"))
def prj_01_melt(spark, d):
    wide = S.table(spark, d, "events").groupBy("user_id").pivot("event_type", list(S.CLASS_OF)).agg(F.sum("value"))
    return wide.unpivot("user_id", list(S.CLASS_OF), "event_type", "total").where("total is not null").select("user_id", "event_type", F.round("total", 4).alias("total"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def agg_12_rows(spark, d):
    w = Window.partitionBy("user_id", F.to_date("ts"), "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return S.table(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("event_id", "user_id", "event_type")


@query("SELECT label, place, round(sum(n * x) / sum(n), 6) AS mean FROM (SELECT label, vec_id % 5 + 1 AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY 1, 2")
def agg_10(spark, d):
    x = S.table(spark, d, "embeddings").select("label", (F.col("vec_id") % 5 + 1).alias("n"), F.posexplode("embedding").alias("at", "x"))
    return x.groupBy("label", (F.col("at") + 1).cast("long").alias("place")).agg(F.round(F.sum(F.col("n") * F.col("x").cast("double")) / F.sum("n"), 6).alias("mean"))


@query("SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY n_regionkey, n_name")
def top_01(spark, d):
    return S.table(spark, d, "nation").select("n_regionkey", "n_name", "n_nationkey").orderBy("n_regionkey", "n_name")


# ---------------------------------------------------- point in time and gates

NEWS = "news AS (SELECT doc_id, doc_id % 25 AS ticker, TIMESTAMP '2024-01-01' + INTERVAL (doc_id * 37 % 720) HOUR AS ts, md5(coalesce(text, '')) AS url_hash FROM documents)"


def news(spark, d) -> DataFrame:
    """(doc_id, ticker, ts, url_hash): documents as news items."""
    hours = F.make_dt_interval(hours=F.col("doc_id") * 37 % 720)
    return docs(spark, d).select("doc_id", (F.col("doc_id") % 25).alias("ticker"), (F.lit("2024-01-01").cast("timestamp_ntz") + hours).alias("ts"), F.md5(F.coalesce("text", F.lit(""))).alias("url_hash"))


@query("SELECT ticker, q, arg_max(concept, prio) AS concept, round(arg_max(value, prio), 2) AS value FROM (SELECT c_nationkey AS ticker, date_trunc('quarter', o_orderdate)::DATE AS q, o_orderpriority AS concept, CASE o_orderpriority WHEN '1-URGENT' THEN 2 ELSE 1 END AS prio, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3) GROUP BY 1, 2")
def pit_02(spark, d):
    """Two tags of one figure become one: of each name and quarter the first tag is taken where it is there."""
    o = S.table(spark, d, "orders").join(S.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    v = o.groupBy(F.col("c_nationkey").alias("ticker"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("q"), F.col("o_orderpriority").alias("concept")).agg(F.sum("o_totalprice").alias("value"))
    prio = F.when(F.col("concept") == "1-URGENT", 2).otherwise(1)
    return v.groupBy("ticker", "q").agg(F.max_by("concept", prio).alias("concept"), F.round(F.max_by("value", prio), 2).alias("value"))


@query(f"SELECT url_hash, doc_id, CAST(ts AS DATE) AS date FROM (WITH {NEWS} SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY ts, doc_id) AS k FROM news) WHERE k = 1")
def pit_04(spark, d):
    first = news(spark, d).groupBy("url_hash").agg(F.min(F.struct("ts", "doc_id")).alias("x"))
    return first.select("url_hash", "x.doc_id", F.to_date("x.ts").alias("date"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY ts, user_id, event_type ORDER BY event_id DESC) AS k FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 10 = 0)) WHERE k = 1")
def pit_05_rows(spark, d):
    """The last row of each event key, of fetches that overlap."""
    e = S.table(spark, d, "events")
    both = e.unionByName(e.where("event_id % 10 = 0"))
    return both.groupBy("ts", "user_id", "event_type").agg(F.max("event_id").alias("event_id")).select("event_id")


@query(f"SELECT ticker, count(*) AS days, round(avg((last IS NOT NULL AND last >= day - INTERVAL 2 DAY)::INT), 6) AS covered FROM (WITH {NEWS} SELECT c.ticker, c.day, max(n.day) AS last FROM (SELECT DISTINCT a.ticker, b.day FROM (SELECT DISTINCT ticker FROM news) a, (SELECT DISTINCT ts::DATE AS day FROM news) b) c LEFT JOIN (SELECT DISTINCT ticker, ts::DATE AS day FROM news) n ON n.ticker = c.ticker AND n.day <= c.day GROUP BY 1, 2) GROUP BY 1")
def qc_07(spark, d):
    held = news(spark, d).select("ticker", F.to_date("ts").alias("day")).distinct()
    days = held.agg(F.sort_array(F.collect_set("day")).alias("days"))  # one row of calendar days
    grid = held.select("ticker").distinct().crossJoin(F.broadcast(days)).select("ticker", F.explode("days").alias("on"))
    got = A.asof(grid, held, ["ticker"], "on", "day", ["day"])
    return got.groupBy("ticker").agg(F.count("*").alias("days"), F.round(F.avg(F.coalesce((F.datediff("on", "matched") <= 2).cast("int"), F.lit(0))), 6).alias("covered"))


#: Weights of the modalities.
GATES = {"price": 0.35, "news": 0.20, "fundamentals": 0.20, "sentiment": 0.15, "macro": 0.10}
_CELLS = "(SELECT count(*) AS n, count(*) FILTER (close > 0 AND low <= least(close, high) + 1e-6 AND high >= close - 1e-6) AS ok, count(DISTINCT ticker) * count(DISTINCT date) AS cells FROM panel)"
_SCORES = f"""SELECT 'price' AS gate, n / cells::DOUBLE AS a, ok / n::DOUBLE AS b, ok = n AS pass FROM {_CELLS}
    UNION ALL SELECT 'news', avg((coalesce(text, '') <> '')::INT), count(DISTINCT text) / count(text)::DOUBLE, count(DISTINCT text) = count(text) FROM documents
    UNION ALL SELECT 'fundamentals', count(o_totalprice) / count(*)::DOUBLE, count(DISTINCT o_orderkey) / count(*)::DOUBLE, count(DISTINCT o_orderkey) = count(*) FROM orders
    UNION ALL SELECT 'sentiment', count(ts) / count(*)::DOUBLE, avg((value >= 0 AND value < 60)::INT), bool_and(ts IS NOT NULL) FROM events
    UNION ALL SELECT 'macro', avg((l_shipdate IS NOT NULL)::INT), avg((l_quantity > 0)::INT), bool_and(l_quantity > 0) FROM lineitem"""


@query(S.with_sql("panel", f"SELECT round(sum(w * 50 * (a + b)), 4) AS overall, bool_and(pass) AS all_pass, coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT pass), '') AS blocked FROM ({_SCORES}) JOIN (VALUES " + ", ".join(f"('{k}', {v})" for k, v in GATES.items()) + ") g(gate, w) USING (gate)"))
def qc_08(spark, d):
    """The weighted score of five modalities, each from two shares, and those whose hard gate fails."""
    share = lambda c: F.avg(F.coalesce(c.cast("int"), F.lit(0)))
    t = lambda n: S.table(spark, d, n)
    sound = (F.col("close") > 0) & (F.col("low") <= F.least("close", "high") + 1e-6) & (F.col("high") >= F.col("close") - 1e-6)
    cells = S.panel(spark, d).agg(F.count("*").alias("n"), F.count_if(sound).alias("ok"), (F.count_distinct("ticker") * F.count_distinct("date")).alias("cells"))
    unique = lambda c, n: F.count_distinct(c) / F.count(n)
    gates = [
        cells.select(F.lit("price").alias("gate"), (F.col("n") / F.col("cells")).alias("a"), (F.col("ok") / F.col("n")).alias("b"), (F.col("ok") == F.col("n")).alias("pass")),
        t("documents").select("text", F.sha2("text", 256).alias("h")).agg(share(F.coalesce("text", F.lit("")) != "").alias("a"), unique("h", "h").alias("b"), (F.count_distinct("h") == F.count("h")).alias("pass")).withColumn("gate", F.lit("news")),
        t("orders").agg((F.count("o_totalprice") / F.count("*")).alias("a"), (F.count_distinct("o_orderkey") / F.count("*")).alias("b"), (F.count_distinct("o_orderkey") == F.count("*")).alias("pass")).withColumn("gate", F.lit("fundamentals")),
        t("events").agg((F.count("ts") / F.count("*")).alias("a"), F.avg(((F.col("value") >= 0) & (F.col("value") < 60)).cast("int")).alias("b"), F.bool_and(F.col("ts").isNotNull()).alias("pass")).withColumn("gate", F.lit("sentiment")),
        t("lineitem").agg(share(F.col("l_shipdate").isNotNull()).alias("a"), F.avg((F.col("l_quantity") > 0).cast("int")).alias("b"), F.bool_and(F.col("l_quantity") > 0).alias("pass")).withColumn("gate", F.lit("macro")),
    ]
    rows = reduce(DataFrame.unionByName, gates)
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in GATES.items() for x in kv)), F.col("gate"))
    return rows.agg(F.round(F.sum(weight * 50 * (F.col("a") + F.col("b"))), 4).alias("overall"), F.bool_and("pass").alias("all_pass"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("pass"), F.col("gate")))), ",").alias("blocked"))


# -------------------------------------------------------- corpus and rewards

_LAST = f"list_extract({TAG}, len({TAG}))"
_NEED = f"(WITH {DEC} SELECT ticker, date, response, {_LAST} AS tag, lag({_LAST}) OVER (PARTITION BY ticker ORDER BY date) AS truth FROM dec)"


def decided(spark, d) -> DataFrame:
    """(ticker, date, response, tag, truth): decisions; the truth stands for the label and is the decision before."""
    return tagged(S.decisions(spark, d)).withColumn("truth", F.lag("tag").over(Window.partitionBy("ticker").orderBy("date")))


@query(S.with_sql("lab", "SELECT ticker, di, cls FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY di) AS rn FROM lab WHERE di BETWEEN 40 AND 300) WHERE rn % 5 = 1"))
def cor_01(spark, d):
    x = classes(signal(P(spark, d))).where("di between 40 and 300")
    return x.withColumn("rn", F.row_number().over(Window.partitionBy("ticker").orderBy("di"))).where("rn % 5 = 1").select("ticker", "di", "cls")


@query(S.with_sql("lab", "SELECT cls, ticker, di FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY di, ticker) AS rn FROM lab) WHERE rn <= (SELECT n FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*)) AS k FROM lab GROUP BY cls) WHERE k = 2)"))
def cor_02(spark, d):
    """Every class cut to the size of the second smallest one, earliest first."""
    x = files.stored(classes(signal(P(spark, d))).select("cls", "ticker", "di"), "labels")
    cap = x.groupBy("cls").agg(F.count("*").alias("n")).withColumn("k", F.row_number().over(Window.orderBy("n"))).where("k = 2").select(F.col("n").alias("cap"))  # five rows
    return O.first_of_each(x, x.select("cls").distinct().crossJoin(F.broadcast(cap)), "cls", "di", "ticker")


@query(S.with_sql("lab", "SELECT cls, ticker, di FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY di, ticker) - 1 AS rn, count(*) OVER (PARTITION BY cls) AS n FROM lab) WHERE rn % greatest(n // 40, 1) = 0 AND rn // greatest(n // 40, 1) < 40"))
def cor_03(spark, d):
    x = files.stored(classes(signal(P(spark, d))).select("cls", "ticker", "di"), "labels")
    return O.every_stride(x, 40, "cls", "di", "ticker")


_GATE = f"(SELECT *, len({TAG}) = 1 AND tag = truth AND regexp_matches(response, '\\]\\]\\]\\s*$') AND NOT regexp_matches(response, '(^|\\n)#') AND len(regexp_extract_all(response, '\\S+')) <= 220 AS good FROM {_NEED})"


def gated(x: DataFrame) -> DataFrame:
    """x plus good: one tag, equal to the label, at the end, no header, at most 220 words."""
    one = F.size(F.expr(r"regexp_extract_all(response, r'(?i)\[\[\[\s*(STRONG_BUY|BUY|HOLD|SELL|STRONG_SELL)\s*\]\]\]', 1)")) == 1
    tail, head = F.col("response").rlike(r"\]\]\]\s*$"), F.col("response").rlike(r"(^|\n)#")
    return x.withColumn("good", one & (F.col("tag") == F.col("truth")) & tail & ~head & (F.size(F.regexp_extract_all("response", F.lit(r"\S+"), F.lit(0))) <= 220))


@query(f"SELECT ticker, date, good FROM {_GATE}")
def cor_05(spark, d):
    return gated(decided(spark, d)).select("ticker", "date", "good")


_NUMBERS = "list_transform(regexp_extract_all(coalesce({0}, ''), '-?[0-9]+(?:\\.[0-9]+)?'), lambda v: v::DOUBLE)"


@query(f"SELECT a, round(CASE WHEN len(t) = 0 THEN 1 ELSE len(list_filter(t, lambda x: len(list_filter(s, lambda y: abs(x - y) <= greatest(0.005 * abs(y), 0.01) OR round(x, 1) = round(y, 1))) > 0))::DOUBLE / len(t) END, 6) AS grounded FROM (SELECT a.doc_id AS a, list_filter({_NUMBERS.format('a.text')}, lambda v: abs(v) >= 1e-6) AS t, {_NUMBERS.format('b.text')} AS s FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)")
def cor_06(spark, d):
    """The share of a text's numbers, zeros left out, that its source (here the next document) holds, nearly or to one place; 1 without any."""
    found = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda v: v.cast("double"))
    x = docs(spark, d).select("doc_id", found.alias("t"))
    said = x.select(F.col("doc_id").alias("a"), F.filter("t", lambda v: F.abs(v) >= 1e-6).alias("t"))
    two = said.join(x.select((F.col("doc_id") - 1).alias("a"), F.col("t").alias("s")), "a")
    near = F.filter("t", lambda u: F.exists("s", lambda v: (F.abs(u - v) <= F.greatest(0.005 * F.abs(v), F.lit(0.01))) | (F.round(u, 1) == F.round(v, 1))))
    return two.select("a", F.round(F.when(F.size("t") == 0, 1.0).otherwise(F.size(near) / F.size("t")), 6).alias("grounded"))


@query(f"WITH d AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id, {_WORDS} AS w FROM documents), t AS (SELECT pos, len(w) AS n, unnest(w) AS x FROM d), m AS (SELECT pos, max(k / (n + o - k)::DOUBLE) AS j FROM (SELECT a.pos, b.pos AS other, any_value(a.n) AS n, any_value(b.n) AS o, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND b.pos <> a.pos AND b.pos BETWEEN a.pos - 200 AND a.pos + 200 GROUP BY 1, 2) GROUP BY 1) SELECT doc_id AS a, round(coalesce(j, 0), 6) AS nearest FROM d LEFT JOIN m USING (pos)")
def cor_07(spark, d):
    """The largest word similarity of a document with the 200 before and the 200 after it."""
    x = O.numbered(docs(spark, d).select("doc_id", "text"), ["doc_id"])
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0)))
    near = B.nearest_in_band(x.select("pos", words.alias("words")), 200)
    return near.join(x.select("pos", "doc_id"), "pos").select(F.col("doc_id").alias("a"), F.round("nearest", 6).alias("nearest"))


_TONE = "len(regexp_extract_all(lower(response), 'purchase|click')) - len(regexp_extract_all(lower(response), 'error|signup'))"


@query(f"SELECT ticker, date, CASE WHEN bet = 0 THEN abs(tone) <= 1 ELSE sign(tone) = sign(bet) END AS faithful FROM (SELECT ticker, date, {_TONE} AS tone, CASE tag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BETS.items()) + f" END AS bet FROM {_NEED}) WHERE bet IS NOT NULL")
def cor_08(spark, d):
    hits = lambda p: F.size(F.regexp_extract_all(F.lower("response"), F.lit(p), F.lit(0)))
    bet = F.try_element_at(F.create_map(*(F.lit(x) for kv in BETS.items() for x in kv)), F.col("tag"))
    x = decided(spark, d).withColumns({"tone": hits("purchase|click") - hits("error|signup"), "bet": bet}).where("bet is not null")
    return x.select("ticker", "date", F.when(F.col("bet") == 0, F.abs("tone") <= 1).otherwise(F.signum("tone") == F.signum("bet")).alias("faithful"))


@query(f"SELECT coalesce(truth, 'none') AS truth, count(*) AS n, round(avg(coalesce(good, FALSE)::INT), 6) AS pass, round(quantile_cont(length(response), 0.1), 6) AS p10 FROM {_GATE} GROUP BY 1")
def cor_09(spark, d):
    g = gated(decided(spark, d)).groupBy(F.coalesce("truth", F.lit("none")).alias("truth"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("good"), F.lit(False)).cast("int")), 6).alias("pass"), F.round(F.percentile(F.length("response"), 0.1), 6).alias("p10"))


@query(f"SELECT ticker, date, CASE WHEN tag = truth THEN '[[[' || truth || ']]]' || chr(10) || response ELSE response END AS completion, CASE WHEN NOT tag = truth THEN 'negatives' WHEN rn % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY ticker, tag = truth ORDER BY date) - 1 AS rn FROM (SELECT ticker, date, response, coalesce(tag, 'HOLD') AS tag, truth FROM {_NEED}) WHERE truth IS NOT NULL)")
def cor_10(spark, d):
    """Answers that hit the truth, label first, split by their place; those that miss it are set aside."""
    x = decided(spark, d).where("truth is not null").withColumn("hit", F.coalesce("tag", F.lit("HOLD")) == F.col("truth"))
    x = x.withColumn("rn", F.row_number().over(Window.partitionBy("ticker", "hit").orderBy("date")) - 1)
    text = F.when(F.col("hit"), F.concat(F.lit("[[["), "truth", F.lit("]]]\n"), "response")).otherwise(F.col("response"))
    return x.select("ticker", "date", text.alias("completion"), F.when(~F.col("hit"), "negatives").when(F.col("rn") % 10 == 0, "val").otherwise("train").alias("split"))


#: A second reader's answers: the first event of a name's day, and none on some days.
_READER = "(SELECT user_id % 25 AS ticker, CAST(ts AS DATE) AS date, arg_min(event_type, {'t': ts, 'i': event_id}) AS kind FROM events WHERE (user_id % 25 + dayofyear(ts)) % 7 <> 0 GROUP BY 1, 2)"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CLASS_OF.items()) + " END"


@query(f"SELECT ticker, date, CASE WHEN pred IS NULL THEN 'unread' WHEN pred = tag THEN 'kept' ELSE 'different' END AS status, CASE WHEN pred = tag THEN '[[[' || tag || ']]]' || chr(10) || trim(split_part(response, '[[[', 1), ' ') END AS completion FROM (SELECT n.*, {_KIND} AS pred FROM {_NEED} n LEFT JOIN {_READER} r USING (ticker, date)) WHERE tag IS NOT NULL")
def cor_11(spark, d):
    """Answers that a second reader of the text alone labels the same are kept, label first; the others are counted by what became of them."""
    e = S.table(spark, d, "events").where((F.col("user_id") % 25 + F.dayofyear("ts")) % 7 != 0)
    name = F.element_at(F.create_map(*(F.lit(x) for pair in S.CLASS_OF.items() for x in pair)), F.col("kind"))
    reader = e.groupBy((F.col("user_id") % 25).alias("ticker"), F.to_date("ts").alias("date")).agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("kind")).select("ticker", "date", name.alias("pred"))
    x = decided(spark, d).where("tag is not null").join(reader, ["ticker", "date"], "left")
    body = F.concat(F.lit("[[["), "tag", F.lit("]]]\n"), F.trim(F.substring_index("response", "[[[", 1)))
    return x.select("ticker", "date", F.when(F.col("pred").isNull(), "unread").when(F.col("pred") == F.col("tag"), "kept").otherwise("different").alias("status"), F.when(F.col("pred") == F.col("tag"), body).alias("completion"))


@query("SELECT c.cls, " + ", ".join(f"count(*) FILTER (x.tag = '{k}') AS {k.lower()}" for k in CLASSES) + " FROM (VALUES " + ", ".join(f"('{k}')" for k in CLASSES) + f") c(cls) LEFT JOIN {_NEED} x ON x.truth = c.cls AND x.tag IS NOT NULL GROUP BY 1")
def agg_06(spark, d):
    """The confusion of truth and answer: a row and a column for each class, also for those that never come."""
    seen = decided(spark, d).where("truth is not null and tag is not null").groupBy(F.col("truth").alias("cls")).pivot("tag", list(CLASSES)).count()
    rows = spark.createDataFrame([(k,) for k in CLASSES], "cls string")
    return rows.join(seen, "cls", "left").select("cls", *(F.coalesce(k, F.lit(0)).alias(k.lower()) for k in CLASSES))


@query(f"SELECT ticker, date, decision, CASE WHEN s > 0 AND k <= 8 THEN 0.125 ELSE 0 END AS weight, round(rate, 6) AS no_tag_rate FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS k, avg(missed) OVER () AS rate FROM (SELECT ticker, date, coalesce(tag, 'HOLD') AS decision, (tag IS NULL)::INT AS missed, CASE tag WHEN 'STRONG_BUY' THEN 2 WHEN 'BUY' THEN 1 ELSE 0 END AS s FROM {_NEED}))")
def pf_03(spark, d):
    """Weights from answers: at most eight names at an eighth each, the strongest first, then in the order of names; and the share of answers without a class."""
    x = decided(spark, d).select("ticker", "date", "tag", F.when(F.col("tag") == "STRONG_BUY", 2).when(F.col("tag") == "BUY", 1).otherwise(0).alias("s"))
    rate = x.agg(F.round(F.avg(F.col("tag").isNull().cast("int")), 6).alias("no_tag_rate"))
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("s"), "ticker"))
    weight = F.when((F.col("s") > 0) & (F.col("k") <= 8), 0.125).otherwise(0.0)
    return x.withColumn("k", k).crossJoin(F.broadcast(rate)).select("ticker", "date", F.coalesce("tag", F.lit("HOLD")).alias("decision"), weight.alias("weight"), "no_tag_rate")  # one row


@query(f"SELECT ticker, date, coalesce(r.reward, {INVALID})::DOUBLE AS reward FROM {_NEED} x LEFT JOIN (VALUES {REWARD_ROWS}) r(said, cls, reward) ON r.said = x.tag AND r.cls = x.truth")
def cor_14(spark, d):
    x = decided(spark, d).join(F.broadcast(rewards(spark).withColumnsRenamed({"said": "tag", "cls": "truth"})), ["tag", "truth"], "left")
    return x.select("ticker", "date", F.coalesce("reward", F.lit(INVALID)).alias("reward"))


@query(f"SELECT ticker, date, round(CASE WHEN bet IS NULL THEN {INVALID} WHEN bet * s < 0 THEN bet * s * 1.5 ELSE bet * s END, 6)::DOUBLE AS reward FROM (SELECT ticker, date, greatest(-3, least(3, (length(response) - 25) / 3.0)) AS s, CASE tag " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BETS.items()) + f" END AS bet FROM {_NEED})")
def cor_15(spark, d):
    """Bet times the clipped signal, losses half as much again; the response's length stands for the signal."""
    bet = F.try_element_at(F.create_map(*(F.lit(x) for kv in BETS.items() for x in kv)), F.col("tag"))
    raw = bet * F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (F.length("response") - 25) / 3.0))
    return decided(spark, d).select("ticker", "date", F.round(F.when(bet.isNull(), INVALID).when(raw < 0, raw * 1.5).otherwise(raw), 6).alias("reward"))


@query(f"SELECT ticker, date, round(1 - count(*) OVER (PARTITION BY date, coalesce(tag, '')) / count(*) OVER (PARTITION BY date)::DOUBLE, 6) AS diversity FROM {_NEED}")
def cor_16(spark, d):
    same, all_ = Window.partitionBy("date", F.coalesce("tag", F.lit(""))), Window.partitionBy("date")
    return decided(spark, d).select("ticker", "date", F.round(1 - F.count("*").over(same) / F.count("*").over(all_), 6).alias("diversity"))


# ---------------------------------------------------------------- indicators


@query(S.with_sql("p", """SELECT ticker, di, round(CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END, 6) AS sma50, round(close / lag(close, 10) OVER v - 1, 6) AS roc10,
    round(CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 + 2 * stddev_samp(close) OVER w20 END, 6) AS boll_up, round(CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 - 2 * stddev_samp(close) OVER w20 END, 6) AS boll_low,
    round(CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END, 6) AS atr, round(CASE WHEN count(ch) OVER w14 = 14 THEN 100 * sum(greatest(ch, 0)) OVER w14 / nullif(sum(abs(ch)) OVER w14, 0) END, 6) AS rsi14,
    round(CASE WHEN count(close) OVER w14 = 14 THEN 100 * (close - min(low) OVER w14) / nullif(max(high) OVER w14 - min(low) OVER w14, 0) END, 6) AS stoch_k
    FROM (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY di) AS ch, greatest(high - low, abs(high - lag(close) OVER (PARTITION BY ticker ORDER BY di)), abs(low - lag(close) OVER (PARTITION BY ticker ORDER BY di))) AS tr FROM p)
    WINDOW v AS (PARTITION BY ticker ORDER BY di), w50 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), w20 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY ticker ORDER BY di ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"""))
def ind_01(spark, d):
    return indicators(P(spark, d))


def indicators(p: DataFrame) -> DataFrame:
    """Indicators of each name and day by their textbook definitions; whole windows only."""
    before = W.shift_own("close", 1)
    x = p.withColumns({"ch": F.col("close") - before, "tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))})
    x = x.withColumns({"rise": F.greatest("ch", F.lit(0.0)), "move": F.abs("ch")})
    mid, sd = W.rolling(F.avg, "close", 20), W.rolling(F.stddev_samp, "close", 20)
    low, high = W.rolling(F.min, "low", 14), W.rolling(F.max, "high", 14)
    ready = F.when(F.count("ch").over(W.own().rowsBetween(-13, 0)) == 14, 100.0)
    found = {
        "sma50": W.rolling(F.avg, "close", 50),
        "roc10": F.col("close") / W.shift_own("close", 10) - 1,
        "boll_up": mid + 2 * sd,
        "boll_low": mid - 2 * sd,
        "atr": W.rolling(F.avg, "tr", 14),
        "rsi14": ready * F.sum("rise").over(W.own().rowsBetween(-13, 0)) / F.nullif(F.sum("move").over(W.own().rowsBetween(-13, 0)), F.lit(0.0)),
        "stoch_k": 100 * (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)),
    }
    return x.select("ticker", "di", *(F.round(c, 6).alias(n) for n, c in found.items()))


__all__ = ["CLASSES", "ORACLE", "QUERIES"]
