"""Queries over the plain tables: reshaping, key sets, text functions, aggregates, top rows and quality gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.release import correct_release_dates, enrich_insider
from tidepanel.sources import fixtures as S

from .panel_queries import P, momentum

QUERIES: dict = {}
ORACLE: dict = {}

#: Classes from the worst to the best with their index, tier and bet.
CLASSES = (("STRONG_SELL", 0, -2), ("SELL", 1, -1), ("HOLD", 2, 0), ("BUY", 3, 1), ("STRONG_BUY", 4, 2))
#: Words counted in texts.
LEXICON = ("the", "and", "data", "license")

_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.CLASS_OF.items())
DEC = f"""dec AS (SELECT ticker, date, 'I read ' || kind || CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN ' [[[ ' || lower(CASE kind {_CASE} END) || ' ]]]' WHEN 2 THEN ' [[[' || CASE kind {_CASE} END || ']]] or [[[MAYBE]]]' ELSE ' [[[' || CASE kind {_CASE} END || ']]]' END AS response FROM (
    SELECT user_id % 25 AS ticker, CAST(ts AS DATE) AS date, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id % 25, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1)"""
TAG = "regexp_extract_all(upper(response), '\\[\\[\\[\\s*(STRONG_BUY|BUY|HOLD|SELL|STRONG_SELL)\\s*\\]\\]\\]', 1)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def count(name: str = "n"):
    return F.count("*").alias(name)


def tagged(dec: DataFrame) -> DataFrame:
    """dec with the last class tag of its response in capitals, of the five classes, spaces and case ignored; null where there is none."""
    found = F.expr(r"regexp_extract_all(response, r'(?i)\[\[\[\s*(STRONG_BUY|BUY|HOLD|SELL|STRONG_SELL)\s*\]\]\]', 1)")
    return dec.withColumn("tag", F.upper(F.try_element_at(found, F.lit(-1))))


# ---------------------------------------------------------------- reshaping


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def prj_01(spark, d):
    wide = S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return wide.select("priority", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in "FOP"))


@query("SELECT user_id, date, kind FROM (SELECT user_id, CAST(ts AS DATE) AS date, event_type AS kind, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def prj_02(spark, d):
    return S.table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def prj_04(spark, d):
    open_ = S.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return S.table(spark, d, "customer").where("c_custkey is not null").join(open_, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def prj_05(spark, d):
    return S.table(spark, d, "orders").where("o_orderdate >= timestamp'1995-01-01' and o_orderdate < timestamp'1996-01-01'").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 10 THEN l_extendedprice END AS price FROM lineitem")
def prj_06(spark, d):
    return S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") >= 10, F.col("l_extendedprice")).alias("price"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders) WHERE k % 5 = 0")
def prj_07(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return S.table(spark, d, "orders").withColumn("k", k).where("k % 5 = 0").select("o_custkey", "o_orderkey")


# ----------------------------------------------------------- joins and sets


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 40)")
def jn_12(spark, d):
    back = S.table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity >= 40").select(F.col("l_partkey").alias("p_partkey"))
    return S.table(spark, d, "part").join(back, "p_partkey", "left_anti").select("p_partkey")


@query(f"WITH {DEC} SELECT ticker, date, idx, bet FROM (SELECT ticker, date, {TAG}[-1] AS tag FROM dec) JOIN (VALUES {', '.join(map(str, CLASSES))}) c(tag, idx, bet) USING (tag)")
def jn_14(spark, d):
    classes = spark.createDataFrame(CLASSES, "tag string, idx int, bet int")  # five rows
    return tagged(S.decisions(spark, d)).join(F.broadcast(classes), "tag").select("ticker", "date", "idx", "bet")


@query("SELECT nation, count(*) AS n FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def set_01(spark, d):
    c = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.unionByName(S.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))).groupBy("nation").agg(count())


@query("SELECT c_custkey AS key FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def set_02(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("key")).intersect(S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key")))


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_03(spark, d):
    return S.table(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(S.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")))


# --------------------------------------------------------- scalar functions


@query(f"WITH {DEC} SELECT ticker, date, coalesce({TAG}[-1], 'NO_TAG') AS tag FROM dec")
def fn_01(spark, d):
    return tagged(S.decisions(spark, d)).select("ticker", "date", F.coalesce("tag", F.lit("NO_TAG")).alias("tag"))


@query("SELECT doc_id, substr(sha1(text), 1, 12) AS short, substr(sha1(text), 1, 16) AS long FROM documents")
def fn_03(spark, d):
    return S.table(spark, d, "documents").select("doc_id", *(F.substr(F.sha1("text"), F.lit(1), F.lit(n)).alias(c) for c, n in (("short", 12), ("long", 16))))


@query("SELECT doc_id, CASE WHEN m = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, CAST(list_sum(list_transform(range(1, 41), lambda i: (strpos('0123456789abcdef', h[i]) - 1) * CASE WHEN i = 40 THEN 1 ELSE 6 END)) AS BIGINT) % 10 AS m FROM (SELECT doc_id, sha1(text) AS h FROM documents WHERE text IS NOT NULL))")
def fn_04(spark, d):
    h = S.table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1("text").alias("h"))
    # 16 = 6 (mod 10), and so is every power of it: the 160-bit number's last digit is one weighted sum of hex digits
    digits = "aggregate(sequence(1, 40), 0, (t, i) -> t + (locate(substr(h, i, 1), '0123456789abcdef') - 1) * if(i = 40, 1, 6))"
    return h.select("doc_id", F.when(F.expr(f"{digits} % 10") == 0, "val").otherwise("train").alias("split"))


@query("SELECT o_orderkey, n + CASE isodow(n) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS next_day, m + CASE isodow(m) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END AS month_8 FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 1 AS n, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) + 7 AS m FROM orders)")
def fn_06(spark, d):
    def rolled(c):
        return F.date_add(c, F.greatest(F.lit(0), F.when(F.weekday(c) >= 5, 7 - F.weekday(c)).otherwise(0)).cast("int"))

    date = F.to_date("o_orderdate")
    return S.table(spark, d, "orders").select("o_orderkey", rolled(F.date_add(date, 1)).alias("next_day"), rolled(F.date_add(F.add_months(F.trunc(date, "month"), 1), 7)).alias("month_8"))


@query("SELECT event_id, least(greatest(coalesce(value, 0), 5), 50) AS clipped, CAST(sign(value - 20) AS INTEGER) AS side FROM events")
def fn_10(spark, d):
    v = F.coalesce(F.nanvl("value", F.lit(None).cast("double")), F.lit(0.0))
    return S.table(spark, d, "events").select("event_id", F.least(F.greatest(v, F.lit(5.0)), F.lit(50.0)).alias("clipped"), F.signum(F.col("value") - 20).cast("int").alias("side"))


@query("SELECT doc_id, len(x) AS n, list_max(x) AS top FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '-?[0-9]+(?:\\.[0-9]+)?'), lambda v: CAST(v AS DOUBLE)) AS x FROM documents WHERE text IS NOT NULL)")
def fn_11(spark, d):
    x = F.transform(F.expr(r"regexp_extract_all(text, r'-?[0-9]+(?:\.[0-9]+)?', 0)"), lambda v: v.cast("double"))
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", x.alias("x")).select("doc_id", F.size("x").cast("long").alias("n"), F.array_max("x").alias("top"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS n_words FROM documents WHERE text IS NOT NULL")
def fn_12(spark, d):
    words = F.array_distinct(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)"))
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", F.size(words).cast("long").alias("n_words"))


@query("SELECT doc_id, CAST(" + " + ".join(f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in LEXICON) + " AS BIGINT) AS hits FROM documents WHERE text IS NOT NULL")
def fn_13(spark, d):
    hits = [(F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w) for w in LEXICON]
    return S.table(spark, d, "documents").where("text is not null").select("doc_id", reduce(lambda a, b: a + b, hits).cast("long").alias("hits"))


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS first, max(CASE WHEN turn = 1 THEN text END) AS reply, count(*) AS turns FROM conversations GROUP BY 1")
def fn_14(spark, d):
    said = [F.max(F.when(F.col("turn") == k, F.col("text"))).alias(c) for k, c in enumerate(("first", "reply"))]
    return S.table(spark, d, "conversations").groupBy("conv_id").agg(*said, count("turns"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def fn_15(spark, d):
    return S.table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(count())


# ------------------------------------------------------ aggregates, top rows


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_03(spark, d):
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count_distinct("o_custkey").alias("customers"))


@query("SELECT event_type, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def agg_05(spark, d):
    counts = S.table(spark, d, "events").groupBy("event_type").agg(count())
    return counts.crossJoin(counts.agg(F.sum("n").alias("all"))).select("event_type", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))  # one row


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def agg_12(spark, d):
    return S.table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), count("copies")).drop("h")


@query("SELECT source, round(1 - count(DISTINCT text) / count(text), 6) AS duplicates FROM documents GROUP BY 1")
def agg_13(spark, d):
    texts = S.table(spark, d, "documents").groupBy("source", F.sha2("text", 256).alias("h")).agg(F.count("text").alias("n"))
    return texts.groupBy("source").agg(F.round(1 - F.count("h") / F.sum("n"), 6).alias("duplicates"))


@query("SELECT n_regionkey AS region, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def agg_15(spark, d):
    return S.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.array_join(F.sort_array(F.collect_set("n_name")), ",").alias("nations"))


@query("SELECT event_type, round(count(*) / sum(1 / greatest(value, 0.01)), 6) AS harmonic FROM events WHERE value IS NOT NULL GROUP BY 1")
def agg_16(spark, d):
    return S.table(spark, d, "events").where("value is not null").groupBy("event_type").agg(F.round(F.count("*") / F.sum(1 / F.greatest("value", F.lit(0.01))), 6).alias("harmonic"))


@query("SELECT y, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM (SELECT year(o_orderdate) AS y, o_totalprice FROM orders) GROUP BY ROLLUP (y)")
def agg_17(spark, d):
    return S.table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("y"), "o_totalprice").rollup("y").agg(count(), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_02(spark, d):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return S.table(spark, d, "orders").select("o_custkey", "o_orderkey", k.cast("long").alias("k")).where("k <= 3")


@query(S.with_sql("mom", "SELECT di, ticker, CASE WHEN up <= 3 THEN 1 ELSE -1 END AS side FROM (SELECT di, ticker, row_number() OVER (PARTITION BY di ORDER BY value DESC, ticker) AS up, row_number() OVER (PARTITION BY di ORDER BY value, ticker) AS down, count(*) OVER (PARTITION BY di) AS n FROM mom) WHERE n >= 6 AND (up <= 3 OR down <= 3)"))
def top_04(spark, d):
    by = Window.partitionBy("di")
    ranked = momentum(P(spark, d)).select("di", "ticker", F.row_number().over(by.orderBy(F.desc("value"), "ticker")).alias("up"), F.row_number().over(by.orderBy("value", "ticker")).alias("down"), F.count("*").over(by).alias("n"))
    return ranked.where("n >= 6 and (up <= 3 or down <= 3)").select("di", "ticker", F.when(F.col("up") <= 3, 1).otherwise(-1).alias("side"))


# ------------------------------------------------------------ quality gates


@query(S.with_sql("own", "SELECT di, ticker FROM (SELECT di, ticker, ln(close) - ln(lag(close) OVER (PARTITION BY ticker ORDER BY di)) AS j FROM p) WHERE abs(j) > 0.5"))
def qc_02(spark, d):
    jump = F.ln("close") - F.ln(F.lag("close").over(Window.partitionBy("ticker").orderBy("di")))
    return P(spark, d).select("di", "ticker", jump.alias("j")).where("abs(j) > 0.5").select("di", "ticker")


@query("SELECT count(*) AS n, count(*) - count(l_shipdate) AS no_date, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS repeated FROM lineitem")
def qc_05(spark, d):
    keys = S.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(count("k"), F.count("l_shipdate").alias("dated"))
    return keys.agg(F.sum("k").alias("n"), (F.sum("k") - F.sum("dated")).alias("no_date"), (F.sum("k") - F.count("*")).alias("repeated"))


@query("SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (l_shipdate < o_orderdate) AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def qc_06(spark, d):
    both = S.table(spark, d, "lineitem").join(S.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(count(), F.count_if(F.col("l_shipdate") < F.col("o_orderdate")).alias("early"))


# ------------------------------------------------------ scans and point in time


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src_01(spark, d):
    return S.table(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_quantity")


#: The columns that a table must have.
REQUIRED = ("doc_id", "quality", "toxic", "reviewed", "source")


@query("SELECT 'universe' AS gate, doc_id::VARCHAR AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'schema', c FROM (VALUES " + ", ".join(f"('{c}')" for c in REQUIRED) + ") r(c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE labels))")
def qc_04(spark, d):
    """What the labels lack: documents without one, and required columns that the table hasn't got."""
    labels = S.table(spark, d, "labels")
    rows = S.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left_anti").select(F.lit("universe").alias("gate"), F.col("doc_id").cast("string").alias("missing"))
    lacking = [("schema", c) for c in REQUIRED if c not in labels.columns]
    return rows.unionByName(spark.createDataFrame(lacking, "gate string, missing string"))


_SERIES = "CASE o_orderstatus WHEN 'F' THEN 'FEDFUNDS' WHEN 'O' THEN 'UNRATE' ELSE 'CPIAUCSL' END"
_ROLL = "CASE isodow({0}) WHEN 6 THEN {0} + 2 WHEN 7 THEN {0} + 1 ELSE {0} END"


@query(f"""WITH m AS (SELECT DISTINCT {_SERIES} AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders UNION ALL SELECT DISTINCT 'DAILY', CAST(o_orderdate AS DATE) FROM orders),
    due AS (SELECT series, date, CASE series WHEN 'DAILY' THEN date + 1 ELSE CAST(date + INTERVAL 1 MONTH AS DATE) + CASE series WHEN 'FEDFUNDS' THEN 2 WHEN 'UNRATE' THEN 7 ELSE 14 END END AS day FROM m)
    SELECT series, date, {_ROLL.format("day")} AS release_date FROM due""")
def pit_01(spark, d):
    o = S.table(spark, d, "orders")
    monthly = o.select(F.expr(_SERIES).alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).distinct()
    return correct_release_dates(monthly.unionByName(o.select(F.lit("DAILY").alias("series"), F.to_date("o_orderdate").alias("date")).distinct()))


_TEXT = "CASE event_type WHEN 'click' THEN ' Sale at price' WHEN 'view' THEN 'Stock Award(Grant)' WHEN 'signup' THEN 'Stock Gift' WHEN 'error' THEN 'Conversion of options' ELSE 'Purchase at price' END"


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'SALE' WHEN 'view' THEN 'GRANT' WHEN 'signup' THEN 'GIFT' WHEN 'error' THEN 'EXERCISE' ELSE 'PURCHASE' END AS txn_type,
    CASE event_type WHEN 'click' THEN 'SELL' WHEN 'purchase' THEN 'BUY' ELSE 'NEUTRAL' END AS direction FROM events""")
def pit_03(spark, d):
    return enrich_insider(S.table(spark, d, "events").select("event_id", F.expr(_TEXT).alias("text"))).drop("text")


@query(S.with_sql("grades", "SELECT date, company, action, max(o_orderkey) AS o_orderkey FROM grades GROUP BY 1, 2, 3"))
def pit_05(spark, d):
    return S.grades(spark, d).groupBy("date", "company", "action").agg(F.max("o_orderkey").alias("o_orderkey"))
