"""Readers and writers of files: keyed and nested JSON, CSV snapshots, replies, feeds, splits, and resumable ingest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share; a folder of our own only where Spark is local and none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{where}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written into the shared folder and read again: computed once, and safe from lost executors."""
    where = scratch(df.sparkSession, name)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def preferred(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table name_pit where it is there, else the table name."""
    try:
        return spark.read.parquet(f"{folder}/{name}_pit.parquet")
    except AnalysisException:
        return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of files {key}.json, each an array of objects, plus `key` from the file's name; empty arrays give no rows."""
    rows = spark.read.option("multiLine", True).schema(schema).json(folder)
    return rows.select("*", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("key"))


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(date, ticker) of a CSV with a date and a comma list of tickers in each row."""
    rows = spark.read.option("header", True).schema("date date, tickers string").csv(path)
    return rows.select("date", F.explode(F.split("tickers", r"\s*,\s*")).alias("ticker")).where("ticker <> ''")


def replies(cache: DataFrame) -> DataFrame:
    """(ticker, date, pred) of prompts and responses: the named ticker and date, and the last class tag; null where there is none."""
    tags = F.regexp_extract_all(F.upper("response"), F.lit(r"\[\[\[\s*(STRONG_BUY|BUY|HOLD|SELL|STRONG_SELL)\s*\]\]\]"), F.lit(1))
    named = lambda word, form: F.nullif(F.regexp_extract("prompt", rf"(?m)^{word}:\s*({form})", 1), F.lit(""))
    return cache.select(named("Ticker", r"\S+").alias("ticker"), F.to_date(named("Date", r"\d{4}-\d\d-\d\d")).alias("date"), F.try_element_at(tags, F.lit(-1)).alias("pred"))


#: Zones that times of feeds may name, as hours and minutes from Greenwich.
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
_ITEMS = "array<struct<title: string, link: string, source: struct<_VALUE: string, _url: string>, pubDate: string>>"
#: Items stand in a channel, or beside it.
_FEED = f"channel struct<item: {_ITEMS}>, item {_ITEMS}, broken string"


def feed_time(said: Column) -> Column:
    """The moment that a time of a feed names: day of the week and seconds may be missing, the zone is a name or hours; null if it is none."""
    form = r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}:\d{2})(:\d{2})?\s*([A-Za-z]+|[+-]\d{4})?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(said, form, k), F.lit(""))
    zone = F.upper(F.coalesce(part(6), F.lit("GMT")))
    named = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    hours = F.when(zone.rlike(r"^[+-]"), zone).otherwise(F.try_element_at(named, zone))
    return F.try_to_timestamp(F.concat(part(1), F.lit(" "), F.initcap(part(2)), F.lit(" "), part(3), F.lit(" "), part(4), F.coalesce(part(5), F.lit(":00")), F.lit(" "), hours), F.lit("d MMM yyyy HH:mm:ss xx"))


def feed_items(feeds: DataFrame, text: str) -> DataFrame:
    """A row for each item of RSS texts: headline, source, url and time (items without a time go), and a row `broken` for each text that is no whole XML.

    Texts are parsed with a schema, so entities, CDATA and namespaces are read as XML has them.
    """
    kept = [c for c in feeds.columns if c != text]
    parsed = feeds.withColumn("_xml", F.from_xml(text, _FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "ignoreNamespace": "true"}))
    bad = F.col("_xml").isNull() | F.col("_xml.broken").isNotNull()
    none = F.array().cast(_ITEMS.replace(": ", ":"))
    items = F.when(~bad, F.concat(F.coalesce("_xml.channel.item", none), F.coalesce("_xml.item", none)))
    rows = parsed.where(F.col(text).isNotNull()).select(*kept, bad.alias("broken"), F.explode_outer(items).alias("item"))
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    rows = rows.select(*kept, "broken", clean("item.title").alias("headline"), clean("item.source._VALUE").alias("source"), clean("item.link").alias("url"), feed_time(F.col("item.pubDate")).alias("published"))
    return rows.where("broken or published is not null")


def write_splits(rows: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines in a folder for each value of the split column."""
    rows.write.partitionBy(split).mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, or CSV with a header."""
    out = rows.write.mode("overwrite")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def ingest(spark: SparkSession, source: str, schema: str | StructType, target: str, checkpoint: str) -> None:
    """Take what is new among the source's files into target; files that a run before took in are skipped, also after a failure."""
    new = spark.readStream.schema(schema).parquet(source)
    query = new.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def write_keyed(rows: DataFrame, path: str) -> None:
    """Files {key}.json with the text `value` of rows (key, value); one row a key, each written by the task that holds it."""
    import pyarrow.fs

    fs, where = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(where, recursive=True)

    def task(batches):
        import pyarrow.fs

        out, folder = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for key, value in zip(b.column("key").to_pylist(), b.column("value").to_pylist(), strict=True):
                with out.open_output_stream(f"{folder}/{key}.json") as f:
                    f.write(value.encode())
            yield b.select(["key"])

    rows.select("key", "value").mapInArrow(task, "key string").write.format("noop").mode("overwrite").save()


def write_parts(rows: DataFrame, part: str, target: str) -> None:
    """Write rows into the folders of their parts; a part that is there is replaced, others stay."""
    rows.write.partitionBy(part).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{target}/parts")


def finished(spark: SparkSession, target: str, schema: StructType, part: str) -> DataFrame:
    """The parts that the manifest lists as whole."""
    kind = StructType([schema[part]])
    try:
        return spark.read.schema(kind).parquet(f"{target}/manifest").distinct()
    except AnalysisException:
        return spark.createDataFrame([], kind)


def ingest_parts(rows: DataFrame, part: str, target: str) -> bool:
    """Take in the parts of rows that the manifest doesn't list, then list them; says whether there were any.

    A run that dies leaves parts without an entry; the next run writes these anew and leaves the others alone.
    """
    done = finished(rows.sparkSession, target, rows.schema, part)
    new = rows.join(F.broadcast(done), part, "left_anti")  # a row a part
    parts = stored(new.select(part).distinct(), "new-parts")
    if parts.isEmpty():
        return False
    write_parts(new, part, target)
    parts.write.mode("append").parquet(f"{target}/manifest")
    return True


def combined(spark: SparkSession, target: str, part: str, keys: list[str]) -> DataFrame:
    """All whole parts as one table, one row a key: that of the last part."""
    rows = spark.read.parquet(f"{target}/parts")
    rows = rows.join(F.broadcast(finished(spark, target, rows.schema, part)), part, "left_semi")
    held = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*held), part).alias("last"))
    return last.select(*keys, "last.*")
