"""Structured Streaming jobs: trailing counts, de-dup, as-of enrichment and the online controller. Each takes a stream and gives one."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidepanel.operators.risk import step


def trailing_counts(events: DataFrame, key: str, length: str = "3 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(key, end, n): events of each key in each sliding window; a window comes out once no event can reach it."""
    return events.withWatermark("ts", late).groupBy(key, F.window("ts", length, step).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first delivery of each key; its repeats within the watermark go."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Events in a block of the state.
BLOCK = 2**16


def packed(at: np.ndarray, ids: np.ndarray) -> list[tuple[bytes]]:
    """Times and ids as blocks, so that the state holds a value for many events."""
    return [(np.stack([at[k : k + BLOCK], ids[k : k + BLOCK]]).astype("<i8").tobytes(),) for k in range(0, at.size, BLOCK)]


def unpacked(blocks: Iterator[tuple[bytes]]) -> np.ndarray:
    """Two rows, times and ids, of all blocks."""
    return np.concatenate([np.empty((2, 0), dtype="<i8"), *(np.frombuffer(b[0], dtype="<i8").reshape(2, -1) for b in blocks)], axis=1)


class NewestFact(StatefulProcessor):
    """Each event of a key with the newest fact at or before it.

    Events wait until the watermark has passed them, so that facts of an earlier time can't come any more; then they go out in
    the order of time, and of the facts only the newest at or before the oldest event that still may come stays. So the state
    is what a key has had within the watermark's delay, and one fact. Events lie in blocks and are matched as arrays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getListState("facts", "at long, fact string")
        self.waiting = handle.getListState("waiting", "block binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for new in rows:
            at, is_event = new["ts"].astype("datetime64[us]").astype("int64").to_numpy(), new["is_event"].to_numpy(dtype=bool)
            if not is_event.all():
                self.facts.appendList(list(zip(at[~is_event].tolist(), new["fact"][~is_event], strict=True)))
            if is_event.any():
                self.waiting.appendList(packed(at[is_event], new["id"].to_numpy(dtype="int64")[is_event]))
                earliest = at[is_event].min()
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            self.handle.registerTimer(int(first) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        safe = timerValues.getCurrentWatermarkInMs()
        at, ids = unpacked(self.waiting.get())
        ready = at // 1000 <= safe
        if not ready.any():  # another timer of this key took them
            return
        facts = sorted(tuple(f) for f in self.facts.get())
        times, said = np.array([f[0] for f in facts], dtype="int64"), np.array([None, *(f[1] for f in facts)], dtype=object)
        left = at[~ready]
        keep = max(0, int(np.searchsorted(times, min([safe * 1000, *([left.min()] if left.size else [])]), "right")) - 1)
        self.waiting.put(packed(left, ids[~ready])) if left.size else self.waiting.clear()
        if keep:
            self.facts.put(facts[keep:])
        if left.size:
            self.handle.registerTimer(int(left.min()) // 1000)
        at, ids = at[ready], ids[ready]
        order = np.lexsort((ids, at))
        at, ids = at[order], ids[order]
        for k in range(0, at.size, BLOCK):
            found = said[np.searchsorted(times, at[k : k + BLOCK], "right")]
            yield pd.DataFrame({"key": key[0], "id": ids[k : k + BLOCK], "fact": found})

    def close(self) -> None:
        pass


def known_then(both: DataFrame, late: str = "1 day") -> DataFrame:
    """(key, id, fact) for a stream (key long, ts, id long, fact string) of events (with an id) and facts (with none).

    An event comes out once the watermark has passed it, with the newest fact of its key at or before it, or null. Late rows
    go. Needs the RocksDB state store.
    """
    # a null among ids would make them floats in pandas
    both = both.select("key", "ts", F.coalesce("id", F.lit(0)).alias("id"), "fact", F.col("id").isNotNull().alias("is_event"))
    return both.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(NewestFact(), "key long, id long, fact string", "Append", "EventTime")


class Controller(StatefulProcessor):
    """The online tail-loss controller of one stream: waits for `warmup` losses, replays them, then steps by the day."""

    def __init__(self, alpha: float, gamma: float, beta: float, warmup: int):
        self.alpha, self.gamma, self.beta, self.warmup = alpha, gamma, beta, warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "low double, high double, c double, q double, x double")
        self.waiting = handle.getListState("waiting", "di int, loss double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(rows).sort_values("di")
        days = list(zip(new["di"].astype(int), -new["r"].astype(float), strict=True))
        if self.held.exists():
            low, high, *state = self.held.get()
        else:
            days = sorted([*((int(d), float(y)) for d, y in self.waiting.get()), *days])
            if len(days) < self.warmup:
                self.waiting.put(days)
                return
            low, high = (float(v) for v in np.quantile([y for _, y in days[: self.warmup]], [0.01, 0.99]))
            state = [0.0, 0.0, 1.0]
            self.waiting.clear()
        out = []
        for day, y in days:
            (x, realized), state = step(y, state, low, high, self.alpha, self.gamma, self.beta)
            out.append((key[0], day, float(x), float(realized)))
        self.held.update((low, high, *(float(v) for v in state)))
        yield pd.DataFrame(out, columns=["stream_id", "di", "exposure", "realized"])

    def close(self) -> None:
        pass


def controlled(returns: DataFrame, alpha: float = 0.005, gamma: float = 0.05, beta: float = 0.85, warmup: int = 60) -> DataFrame:
    """(stream_id, di, exposure, realized) of a stream (stream_id, di, r) whose days arrive in order for each stream_id.

    Equals the batch controller; nothing comes out before a stream has `warmup` losses, as the scale comes from them. Needs
    the RocksDB state store.
    """
    job = Controller(alpha, gamma, beta, warmup)
    return returns.where("r is not null").groupBy("stream_id").transformWithStateInPandas(job, "stream_id string, di int, exposure double, realized double", "Append", "None")


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as __) for the time of a run."""
    before = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_table(stream: DataFrame, target: str, checkpoint: str, last: bool = True) -> None:
    """Run a stream over all that is there and append its rows to a Parquet table, exactly once.

    A run that isn't the last one leaves what waits for the watermark in the state, for the run after it.
    """
    with settings(stream.sparkSession, spark__sql__streaming__noDataMicroBatches__enabled=str(last).lower()):
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
