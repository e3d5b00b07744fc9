"""The nearest other text in a moving band of places: an exact set join with rare words first and bounds on what is left."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_band(x: DataFrame, width: int = 200, block: int = 1000) -> DataFrame:
    """(pos, nearest) for x (pos long, words array<string> of distinct words): the largest Jaccard with a row at most width places away; 0 without any.

    Rows are cut into blocks of places, and a block also sees the rows up to `width` beyond its ends, so each row is sent to at
    most two blocks more (1.4 times in all). A task holds one block. Empty sets have a similarity of 0 with all.
    """
    block = max(block, width)
    at = F.floor(F.col("pos") / block)
    to = F.array(F.struct(at.alias("block"), F.lit(True).alias("own")), F.struct(F.when(F.col("pos") % block < width, at - 1).alias("block"), F.lit(False).alias("own")), F.struct(F.when(F.col("pos") % block >= block - width, at + 1).alias("block"), F.lit(False).alias("own")))
    sent = x.withColumn("to", F.explode(F.filter(to, lambda b: b["block"].isNotNull()))).select("to.block", "to.own", "pos", "words")

    def nearest(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos").combine_chunks()
        pos, own = t.column("pos").to_numpy(), t.column("own").to_numpy()
        best = _best(pos, own, t.column("words").combine_chunks(), width)
        return pa.table({"pos": pos[own], "nearest": best})

    return sent.groupBy("block").applyInArrow(nearest, "pos long, nearest double")


def _best(pos: np.ndarray, own: np.ndarray, words: pa.ListArray, width: int) -> np.ndarray:
    """The largest Jaccard of each own row within its band.

    A row's words are taken rarest first. After each part of them the overlap so far bounds every partner's similarity from
    below, and with all that is left from above; it ends when none but a few can still win, and these are compared whole. So
    the words that most rows share are seldom looked up.
    """
    n = len(pos)
    size = np.diff(words.offsets.to_numpy()).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    rare = np.empty(len(coded.dictionary), np.int64)
    rare[np.argsort(np.bincount(code, minlength=len(rare)), kind="stable")] = np.arange(len(rare))
    code, row = rare[code], np.repeat(np.arange(n), size)
    by_row = code[np.lexsort((code, row))]
    start = np.concatenate([[0], np.cumsum(size)])
    keys = np.sort(code * n + row)  # each word's rows in order
    low, high = np.searchsorted(pos, pos - width, "left"), np.searchsorted(pos, pos + width, "right")
    out = []
    for d in np.flatnonzero(own):
        mine, lo, hi = by_row[start[d] : start[d + 1]], low[d], high[d]
        s, others, met, best, done, step = len(mine), size[lo:hi], np.zeros(hi - lo, np.int64), 0.0, 0, 8
        there = np.ones(hi - lo, bool)
        there[d - lo] = False
        while done < s:
            part = mine[done : done + step]
            a, b = np.searchsorted(keys, part * n + lo), np.searchsorted(keys, part * n + hi)
            many = b - a
            place = np.repeat(a - np.cumsum(many) + many, many) + np.arange(many.sum())
            met += np.bincount(keys[place] - np.repeat(part * n, many) - lo, minlength=hi - lo)
            done, step = done + len(part), 2 * step
            best = max(best, (met / (s + others - met))[there].max(initial=0.0))
            reach = np.minimum(met + s - done, others)
            there &= reach / (s + others - reach) > best
            left = np.flatnonzero(there)
            if len(left) <= 4:
                for j in left:
                    theirs = by_row[start[lo + j] : start[lo + j + 1]]
                    both = len(np.intersect1d(mine, theirs, assume_unique=True))
                    best = max(best, both / (s + len(theirs) - both))
                break
        out.append(best)
    return np.array(out, np.float64)
