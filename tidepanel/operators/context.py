"""What was known then: the newest items of each kind as of a time, from one merged timeline of counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators.order import running
from tidepanel.sources.files import stored


@dataclass(frozen=True)
class Edge:
    """A time `days` before the question; an edge that is `inside` leaves items of that very time on its newer side."""

    days: int
    inside: bool = False


@dataclass(frozen=True)
class Bucket:
    """Items from the newer edge back to the older one (None: from the first item on), at most `cap` of them (None: all)."""

    tag: str
    newer: Edge
    older: Edge | None
    cap: int | None


NOW = Edge(0)


def within_reach(asked: DataFrame, items: DataFrame, kinds: dict[str, list[Bucket]]) -> DataFrame:
    """The items that some question of their name, key and kind can take by its time; the others would only be counted along."""
    spans = {kind: max(b.older.days for b in bs) for kind, bs in kinds.items() if all(b.older for b in bs)}
    days = F.coalesce(F.lit(None).cast("int"), *(F.when(F.col("kind") == kind, F.lit(n)) for kind, n in spans.items()))
    reach = asked.groupBy("name", "key", "kind").agg(F.min("as_of").alias("_first"), F.max("as_of").alias("_last"))
    # a kind with an open bucket reaches back to its first item
    reach = reach.withColumn("_from", F.col("_first") - F.make_dt_interval(days=days))
    near = items.join(reach, ["name", "key", "kind"]).where((F.col("ts") <= F.col("_last")) & (F.col("_from").isNull() | (F.col("ts") >= F.col("_from"))))
    return near.drop("_first", "_last", "_from")


def newest(asked: DataFrame, items: DataFrame, kinds: dict[str, list[Bucket]]) -> DataFrame:
    """(name, key, kind, as_of, bucket, back, item): for each question the newest items of its name, key and kind in each bucket.

    asked (name, key, kind, as_of); items (name, key, kind, ts, tie, item); bucket is the place in the kind's list, back counts
    from 0 at the newest. No item later than as_of is ever met.

    Items and the edges of all questions lie in one timeline. How many items stand before an edge says which places a bucket
    takes, and these meet the items by an equi-join: at most `cap` rows a bucket, whatever the number of items in its span.
    Items that no question reaches stay out of it.
    The counts are running sums over a range partitioning, so a name of any size is spread.
    """
    edges = {kind: list(dict.fromkeys(e for b in bs for e in (b.newer, b.older) if e)) for kind, bs in kinds.items()}
    marks = None
    for kind, es in edges.items():
        at = F.array(*(F.struct(F.lit(k).alias("edge"), (F.col("as_of") - F.make_dt_interval(days=F.lit(e.days))).alias("at"), F.lit(0 if e.inside else 2).alias("tag")) for k, e in enumerate(es)))
        own = asked.where(F.col("kind") == kind).select("name", "key", "kind", "as_of", F.explode(at).alias("m")).select("name", "key", "kind", "m.at", "m.tag", F.lit(None).cast("long").alias("tie"), F.lit(0).alias("one"), "as_of", "m.edge")
        marks = own if marks is None else marks.unionByName(own)
    line = within_reach(asked, items, kinds).select("name", "key", "kind", F.col("ts").alias("at"), F.lit(1).alias("tag"), F.col("tie").cast("long").alias("tie"), F.lit(1).alias("one"), "item")
    counted = stored(running(line.unionByName(marks, allowMissingColumns=True), ["name", "key", "kind"], ["at", "tag", "tie"], "one", "place"), "timeline")
    most = max(map(len, edges.values()))
    seen = counted.where("tag <> 1").groupBy("name", "key", "kind", "as_of").agg(*(F.max(F.when(F.col("edge") == k, F.col("place"))).alias(f"e{k}") for k in range(most)))
    wanted = F.array().cast("array<struct<bucket:int,back:bigint,place:bigint>>")
    for kind, bs in kinds.items():
        for k, b in enumerate(bs):
            top = F.col(f"e{edges[kind].index(b.newer)}")
            low = F.col(f"e{edges[kind].index(b.older)}") if b.older else F.lit(0).cast("long")
            low = low if b.cap is None else F.greatest(low, top - b.cap)
            # a sequence of no places would run backwards
            taken = F.when((F.col("kind") == kind) & (top > low), F.transform(F.sequence(low + 1, top), lambda p: F.struct(F.lit(k).alias("bucket"), (top - p).alias("back"), p.alias("place")))).otherwise(F.array().cast("array<struct<bucket:int,back:bigint,place:bigint>>"))  # noqa: B023
            wanted = F.concat(wanted, taken)
    asked_for = seen.select("name", "key", "kind", "as_of", F.explode(wanted).alias("w")).select("name", "key", "kind", "as_of", "w.bucket", "w.back", "w.place")
    # a bucket without a cap asks for any number of places, which Spark's estimate of an explode doesn't show: never broadcast them
    return asked_for.hint("merge").join(counted.where("tag = 1").select("name", "key", "kind", "place", "item"), ["name", "key", "kind", "place"]).drop("place")


#: Spans of news with their caps, or all of 60 days; days and caps of the other kinds; titles of the sections and the line of an empty one.
NEWS = [Bucket("≤3d", NOW, Edge(4), 10), Bucket("4-10d", Edge(4), Edge(11), 20), Bucket("11-30d", Edge(11), Edge(30, True), 20)]
RICH = [Bucket("", NOW, Edge(60, True), None)]
LATEST = [Bucket("", NOW, None, 1)]
TITLES = {"news": "NEWS (last {0}d)", "fundamental": "FUNDAMENTALS (latest filed)", "sentiment": "SENTIMENT", "macro": "MACRO (latest)"}
NONE = "  none"


def kinds(rich: bool = False, events: int = 12) -> dict[str, list[Bucket]]:
    """The buckets of each kind."""
    some = [Bucket("", NOW, Edge(90, True), events)]
    return {"news": RICH if rich else NEWS, "fundamental": LATEST, "analyst": some, "insider": some, "macro": LATEST}


def sections(asked: DataFrame, items: DataFrame, rich: bool = False, events: int = 12) -> DataFrame:
    """asked (ticker, as_of) plus `context`: the text of what was known of a ticker, section by section.

    items (name, key, kind, ts, tie, item): an item is a line of text; macro items go by the name `*`, all others by their ticker.
    Each concept of fundamentals and each series is a key of its own, of which the latest counts.
    """
    of = kinds(rich, events)
    asked = stored(asked.select(F.col("ticker").cast("string").alias("name"), "as_of").distinct(), "asked")
    keys = items.select("name", "key", "kind").distinct()
    own = asked.join(keys.where("name <> '*'"), "name").select("name", "key", "kind", "as_of")
    shared = asked.select("as_of").distinct().crossJoin(keys.where("name = '*'")).select("name", "key", "kind", "as_of")  # a row a series and day
    found = newest(own.unionByName(shared), items, of)
    lines = lambda rows, by: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("kind", "bucket", "key", "back", "item"))).alias("found"))
    mine, all_ = lines(found.where("name <> '*'"), ["name", "as_of"]), lines(found.where("name = '*'"), ["as_of"]).withColumnRenamed("found", "macro")
    # the lines of all questions together are as large as the result
    x = asked.join(mine.hint("merge"), ["name", "as_of"], "left").join(all_, "as_of", "left")
    text = lambda kind, c="found", bucket=None: F.transform(F.filter(c, lambda e: (e["kind"] == kind) & (F.lit(True) if bucket is None else e["bucket"] == bucket)), lambda e: e["item"])
    none = F.array().cast("array<string>")

    def section(title: str, *parts: Column) -> Column:
        rows = F.concat(*(F.coalesce(p, none) for p in parts))
        return F.concat(F.array(F.lit(f"=== {title} ===")), F.when(F.size(rows) == 0, F.array(F.lit(NONE))).otherwise(rows))

    def span(k: int, tag: str) -> Column:
        rows = text("news", bucket=k)
        return F.when(F.size(rows) > 0, F.concat(F.array(F.lit(f"  [{tag}]")), rows)) if tag else rows

    out = F.concat(
        section(TITLES["news"].format(60 if rich else 30), *(span(k, b.tag) for k, b in enumerate(of["news"]))),
        section(TITLES["fundamental"], text("fundamental")),
        section(TITLES["sentiment"], text("analyst"), text("insider")),
        section(TITLES["macro"], text("macro", "macro")),
    )
    return x.select(F.col("name").alias("ticker"), "as_of", F.array_join(out, "\n").alias("context"))
