"""Streams, sources and sinks as queries: each writes into the shared folder, and gives what a reader finds there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.sources import files, fixtures as S
from tidepanel.streaming import jobs

from .panel_queries import P
from .product_queries import membership

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


#: Days of a split; a fiftieth of its rows come two splits late, and a twentieth come again one split later.
SPLIT = 8


def delivered(events: DataFrame, repeats: bool = True) -> DataFrame:
    """events plus batch: the deliveries that a row comes in, in the order of splits of days."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    split = F.floor(day / SPLIT).cast("int") + F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    again = F.when(F.lit(repeats) & (F.col("event_id") % 20 == 0), F.array(split, split + 1)).otherwise(F.array(split))
    return events.withColumn("batch", F.explode(again))


#: The deliveries, the watermark that decides on a delivery's late rows (from what came two deliveries before), and the last one.
DELIVERED = f"""came AS (SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // {SPLIT} + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END + k AS batch FROM events, (VALUES (0), (1)) t(k) WHERE k = 0 OR event_id % 20 = 0),
    mark AS (SELECT b.batch, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM came c WHERE c.batch <= b.batch - 2) AS late FROM (SELECT DISTINCT batch FROM came) b),
    fit AS (SELECT came.*, late FROM came JOIN mark USING (batch)), fin AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS done FROM events)"""


def in_deliveries(spark, rows: DataFrame, job, name: str) -> DataFrame:
    """What a job leaves in a table if rows (with `batch`) come delivery by delivery, the job stopped and started again between."""
    where = files.scratch(spark, name)
    schema = rows.drop("batch").schema
    kept = files.stored(rows, f"{name}-deliveries")
    batches = [r[0] for r in kept.select("batch").distinct().orderBy("batch").collect()]  # a few
    out = None
    for b in batches:
        kept.where(F.col("batch") == b).drop("batch").write.mode("append").parquet(f"{where}/source")
        out = job(spark.readStream.schema(schema).parquet(f"{where}/source"))
        jobs.run_to_table(out, f"{where}/table", f"{where}/checkpoint", last=b == batches[-1])
    return spark.read.schema(out.schema).parquet(f"{where}/table")


def stamped(spark, d) -> DataFrame:
    return S.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(f"WITH {DELIVERED} SELECT user_id, strftime(w, '%Y-%m-%d') AS ends, count(*) AS n FROM (SELECT *, date_trunc('day', ts) + INTERVAL (d) DAY AS w FROM fit, (VALUES (1), (2), (3)) s(d)) WHERE (late IS NULL OR w > late) AND w <= (SELECT done FROM fin) GROUP BY 1, 2")
def st_02(spark, d):
    """Rows of windows that are closed when they come don't count; repeats do."""
    got = in_deliveries(spark, delivered(stamped(spark, d)), lambda e: jobs.trailing_counts(e, "user_id"), "windows")
    return got.select("user_id", F.date_format("end", "yyyy-MM-dd").alias("ends"), "n")


@query(f"WITH {DELIVERED} SELECT DISTINCT event_id, user_id, event_type FROM fit WHERE late IS NULL OR ts > late")
def st_03(spark, d):
    """Each event once, however often it comes; those that come too late don't."""
    return in_deliveries(spark, delivered(stamped(spark, d)), lambda e: jobs.once(e, ["event_id"]), "once").select("event_id", "user_id", "event_type")


@query(f"WITH {DELIVERED}, facts AS (SELECT ticker, date + INTERVAL 1 DAY AS ts, strftime(date, '%Y-%m-%d') AS fact FROM (SELECT DISTINCT user_id % 25 AS ticker, CAST(ts AS DATE) AS date FROM events WHERE event_type = 'purchase')) SELECT e.event_id, f.fact FROM (SELECT DISTINCT event_id, user_id % 25 AS ticker, ts FROM fit WHERE k = 0 AND (late IS NULL OR ts > late) AND ts <= (SELECT done FROM fin)) e ASOF LEFT JOIN facts f ON f.ticker = e.ticker AND e.ts >= f.ts")
def st_04(spark, d):
    """Each event with the last day on which its name had a purchase, known from the day after; facts come in the same deliveries."""
    e = stamped(spark, d).withColumn("key", F.col("user_id") % 25)
    known = e.where("event_type = 'purchase'").select("key", F.to_date("ts").alias("on")).distinct()
    fact = known.select("key", F.date_add("on", 1).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("id"), F.date_format("on", "yyyy-MM-dd").alias("fact"))
    fact = fact.withColumn("batch", F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / SPLIT).cast("int")).where(F.col("ts") <= F.lit(e.agg(F.max("ts")).first()[0]))
    event = delivered(e, repeats=False).select("key", "ts", F.col("event_id").alias("id"), F.lit(None).cast("string").alias("fact"), "batch")
    with jobs.settings(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        return in_deliveries(spark, event.unionByName(fact), jobs.known_then, "facts").select(F.col("id").alias("event_id"), "fact")


@query("SELECT event_id, user_id, event_type FROM events")
def st_05(spark, d):
    """The ingest run twice: the second run finds nothing new."""
    where, schema = files.scratch(spark, "ingest"), S.table(spark, d, "events").schema
    for _ in range(2):
        files.ingest(spark, f"{d}/events*.parquet", schema, f"{where}/table", f"{where}/checkpoint")
    return spark.read.schema(schema).parquet(f"{where}/table").select("event_id", "user_id", "event_type")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def src_02(spark, d):
    where = files.scratch(spark, "variants")
    files.write_table(S.table(spark, d, "labels"), f"{where}/labels_pit.parquet")
    files.write_table(S.table(spark, d, "documents").select("doc_id", "lang"), f"{where}/documents.parquet")
    return files.preferred(spark, where, "documents").join(files.preferred(spark, where, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT conv_id, turn, role, md5(coalesce(text, '')) AS said FROM conversations")
def src_04(spark, d):
    """Conversations as nested JSON lines, written and read again."""
    where = files.scratch(spark, "jsonl")
    turns = S.table(spark, d, "conversations")
    turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("messages")).write.json(where)
    kind = turns.schema
    schema = f"conv_id {kind['conv_id'].dataType.simpleString()}, messages array<struct<turn:{kind['turn'].dataType.simpleString()},role:string,text:string>>"
    back = files.jsonl(spark, where, schema).select("conv_id", F.inline("messages"))
    return back.select("conv_id", "turn", "role", F.md5(F.coalesce("text", F.lit(""))).alias("said"))


@query(S.with_sql("p", "SELECT y, ticker FROM (SELECT year(date) + 1 AS y, ticker, row_number() OVER (PARTITION BY year(date) ORDER BY sum(volume) DESC, ticker) AS k FROM p GROUP BY year(date), ticker) WHERE k <= 15"))
def src_05(spark, d):
    where = files.scratch(spark, "snapshots")
    files.write_table(membership(P(spark, d)).select(F.col("snap").alias("date"), "tickers"), where, "csv")
    return files.snapshots(spark, where).select(F.year("date").cast("long").alias("y"), F.col("ticker").cast("int").alias("ticker"))


@query("SELECT event_id::VARCHAR AS ticker, CAST(ts AS DATE) AS date, CASE event_type WHEN 'click' THEN 'BUY' WHEN 'purchase' THEN 'STRONG_BUY' WHEN 'view' THEN 'HOLD' WHEN 'signup' THEN 'SELL' ELSE 'STRONG_SELL' END AS pred FROM events")
def src_06(spark, d):
    where = files.scratch(spark, "replies")
    name = F.element_at(F.create_map(*(F.lit(x) for pair in S.CLASS_OF.items() for x in pair)), F.col("event_type"))
    prompt = F.concat(F.lit("A question.\nTicker: "), F.col("event_id").cast("string"), F.lit("\nDate: "), F.date_format("ts", "yyyy-MM-dd"))
    S.table(spark, d, "events").select(prompt.alias("prompt"), F.concat(F.lit("first [[[HOLD]]], then [[[ "), F.lower(name), F.lit(" ]]]")).alias("response")).write.json(where)
    return files.replies(files.jsonl(spark, where, "prompt string, response string"))


@query("SELECT doc_id, split, quality FROM (SELECT doc_id, quality, CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM labels)")
def snk_02(spark, d):
    where = files.scratch(spark, "splits")
    files.write_splits(S.table(spark, d, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split")), where)
    return files.jsonl(spark, where, "doc_id long, quality int, split string").select("doc_id", "split", "quality")


@query("SELECT doc_id, kind, strftime(coalesce(ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS at FROM (SELECT doc_id, 'item' AS kind, TIMESTAMP '2024-01-01' + INTERVAL (doc_id * 37 % 720) HOUR AS ts FROM documents WHERE doc_id % 12 <> 5 AND doc_id // 10 % 17 <> 3 UNION ALL SELECT DISTINCT doc_id // 10, 'broken', NULL FROM documents WHERE doc_id // 10 % 17 = 3)".replace("doc_id, kind, strftime", "doc_id AS id, kind, strftime"))
def src_07(spark, d):
    """Feeds of ten documents each, with entities, CDATA, prefixes and the zones of their times; every seventeenth breaks off."""
    items = files.feed_items(feeds(spark, d), "xml")
    kind, id_ = F.when(F.col("broken"), "broken").otherwise("item"), F.when(F.col("broken"), F.col("feed")).otherwise(F.regexp_extract("url", r"doc=(\d+)&from=feed", 1).cast("long"))
    return items.select(id_.alias("id"), kind.alias("kind"), F.date_format(F.coalesce("published", F.lit("1970-01-01").cast("timestamp")), "yyyy-MM-dd HH:mm").alias("at"))


def feeds(spark, d) -> DataFrame:
    """(feed, xml): documents as the items of feeds."""
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    x = S.table(spark, d, "documents").where("doc_id is not null")
    title = F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 60), r"[^\x20-\x7e]", "?")
    # the same moment in zones of the standard: names, and hours from Greenwich
    zones = [("GMT", 0), ("EST", -300), ("PDT", -420), ("+0530", 330), ("-0230", -150), ("UT", 0)]
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id") * 37 % 720)
    when = F.coalesce(*(F.when(F.col("doc_id") % len(zones) == k, F.concat(F.date_format(at + F.make_dt_interval(mins=F.lit(m)), "E, dd MMM yyyy HH:mm:ss "), F.lit(z))) for k, (z, m) in enumerate(zones)))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<title><![CDATA["), F.replace(title, F.lit("]]>"), F.lit("")), F.lit("]]></title>"))).otherwise(F.concat(F.lit("<title>"), escaped(title), F.lit("</title>")))
    item = F.concat(F.lit("<item>"), head, F.lit("<link>https://example.org/?doc="), F.col("doc_id").cast("string"), F.lit("&amp;from=feed</link><source url='s'>"), escaped(F.coalesce("source", F.lit(""))), F.lit("</source><dc:creator>me</dc:creator>"), F.when(F.col("doc_id") % 12 == 5, "").otherwise(F.concat(F.lit("<pubDate>"), when, F.lit("</pubDate>"))), F.lit("</item>"))
    xml = F.concat(F.lit("<?xml version='1.0'?><rss xmlns:dc='http://purl.org/dc/elements/1.1/'><channel><title>a feed</title>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
    rows = x.groupBy(F.floor(F.col("doc_id") / 10).alias("feed")).agg(xml.alias("xml"))  # ten items each
    return rows.withColumn("xml", F.when(F.col("feed") % 17 == 3, F.expr("substring(xml, 1, length(xml) - 30)")).otherwise(F.col("xml")))


@query("SELECT user_id::VARCHAR AS key, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def src_03(spark, d):
    """A JSON array in a file for each user, one more user with an empty array, and one without a file."""
    where = files.scratch(spark, "keyed")
    rows = S.table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct("event_id", "value"))).alias("value"))
    rows = rows.select(F.col("user_id").cast("string").alias("key"), "value").unionByName(spark.sql("SELECT 'none' AS key, '[]' AS value"))
    files.write_keyed(rows, where)
    back = files.keyed_json(spark, where, "event_id long, value double")
    return back.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


#: Parts are spans of five days; each also brings the last day of the part before again, its values one higher.
_FETCHED = "SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events"


@query(f"SELECT event_id, part, value FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY part DESC) AS k FROM (SELECT event_id, (day // 5)::INT AS part, value FROM ({_FETCHED}) UNION ALL SELECT event_id, (day // 5)::INT + 1, value + 1 FROM ({_FETCHED}) WHERE day % 5 = 4)) WHERE k = 1")
def snk_04(spark, d):
    """Ingest by parts: a first run takes some, a second dies with a part half written, a third takes what is missing, a fourth nothing."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    e = S.table(spark, d, "events").select("event_id", "value", day.alias("day"))
    part = F.floor(F.col("day") / 5).cast("int")
    fetched = e.select("event_id", part.alias("part"), "value").unionByName(e.where("day % 5 = 4").select("event_id", (part + 1).alias("part"), (F.col("value") + 1).alias("value")))
    where = files.scratch(spark, "parts")
    files.ingest_parts(fetched.where("part < 2"), "part", where)
    files.write_parts(fetched.where("part = 2 and event_id % 2 = 0"), "part", where)  # what a lost run leaves: no entry in the manifest
    files.ingest_parts(fetched, "part", where)
    if files.ingest_parts(fetched, "part", where):
        raise AssertionError("parts in the manifest were taken again")
    return files.combined(spark, where, "part", ["event_id"]).select("event_id", "part", "value")
