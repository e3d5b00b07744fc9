"""op11: hard negatives by the threshold algorithm over sorted lists of each dimension.

Candidates are dealt into blocks of bounded size by a hash. A task holds one block: its vectors and, for each dimension, the
rows in descending order. Anchors stream by. For each anchor the lists are read in step, from the top where its component is
positive and from the bottom where it is negative; a row met for the first time is scored by its whole integer inner product
(random access). The sum of the anchor's components with the values at the present depth bounds every row not met yet, so
reading stops once that bound is strictly below the k-th score found in each window (strictly, since ties go to the smaller
id). A window that isn't full has its lower end as that score: nothing under it may enter. The best of each block then meet in
one ranking. No row is left out: a block read to its end is the worst case, not a limit.

Two rounds: positives (one window without ends, own label), then for each positive its window of scores among other labels.

Rows: a null label, vector or id, or a null or non-finite component: no part. Components become floor(256 x), x as double;
beyond a long they saturate, and so do scores. Vectors of different lengths don't meet. Of rows that repeat an id the one with the
smallest (label, vector) counts. Copies under different ids all count. Extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Rows of a block: 64 dimensions of them are 8 MB of doubles and 2 MB of lists.
BLOCK = 16_384
_LOW, _HIGH = -(2**63), 2**63 - 1
_ROWS = "block int, part int, id long, label long, q array<long>, wanted array<struct<name:long,score:long>>"
_FOUND = "id long, name long, given long, other long, score long"


def quantised(vector: Column | str) -> Column:
    """floor(256 x) of each component as longs; null for a vector that is null or holds a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(256.0 * x.cast("double"))))


class Lists:
    """The rows of a block that have vectors of one length, with each dimension's rows in descending order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.x = q.astype(np.float64)
        kind = np.uint16 if len(ids) <= 1 << 16 else np.int32
        self.order = np.argsort(-self.x, axis=0, kind="stable").T.astype(kind).copy()
        self.most = float(np.abs(self.x).max(initial=0.0))
        self._of: dict[int, Lists] = {}

    def of_label(self, label: int) -> Lists:
        if label not in self._of:
            own = self.labels == label
            self._of[label] = Lists(self.ids[own], self.labels[own], self.q[own])
        return self._of[label]

    def search(self, anchor: np.ndarray, may: np.ndarray, low: list[int], high: list[int], k: int) -> list[np.ndarray]:
        """For each window the first k rows (score descending, id ascending) that `may` be taken; pairs (row, score) as columns."""
        n, a = len(self.ids), anchor.astype(np.float64)
        exact = self.most * float(np.abs(a).max(initial=0.0)) * max(len(a), 1) < 2**53  # then sums of doubles are whole
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        kept = [np.zeros((2, 0), np.int64) for _ in low]
        bar = [lo if lo <= hi else _HIGH + 1 for lo, hi in zip(low, high, strict=True)]
        met, depth, step = np.zeros(n, bool), 0, 32
        while depth < n and not met.all():
            end = min(n, depth + step)
            now = np.zeros(n, bool)
            if len(up) + len(down):
                now[self.order[up, depth:end].ravel()] = True
                now[self.order[down, n - end : n - depth].ravel()] = True
            else:
                now[:] = True  # an anchor of zeros reads no list: all score zero
            now &= ~met
            met |= now
            fresh = np.flatnonzero(now & may)
            scores = self._scores(fresh, anchor, a, exact)
            near = scores >= max(min(bar), _LOW) if min(bar) <= _HIGH else np.zeros(len(fresh), bool)
            fresh, scores = fresh[near], scores[near]
            for w, (lo, hi) in enumerate(zip(low, high, strict=True)):
                fits = (scores >= max(lo, _LOW)) & (scores <= min(hi, _HIGH)) if lo <= hi else np.zeros(len(fresh), bool)
                if fits.any():
                    both = np.concatenate([kept[w], np.stack([fresh[fits], scores[fits]])], axis=1)
                    first = np.lexsort((self.ids[both[0]], ~both[1]))[:k]
                    kept[w] = both[:, first]
                    if len(first) == k:
                        bar[w] = int(kept[w][1, -1])
            bound = self._bound(anchor, a, exact, up, down, end - 1, n - end)
            if all(bound < b for b in bar):
                break
            depth, step = end, 2 * step
        return kept

    def _scores(self, rows, anchor, a, exact) -> np.ndarray:
        if exact:
            return (self.x[rows] @ a).astype(np.int64)
        whole = (self.q[rows].astype(object) * anchor.astype(object)).sum(axis=1) if len(rows) else []
        return np.array([min(max(int(s), _LOW), _HIGH) for s in whole], np.int64)

    def _bound(self, anchor, a, exact, up, down, top, bottom):
        """No row not met yet scores more."""
        if exact:
            return float((a[up] * self.x[self.order[up, top], up]).sum() + (a[down] * self.x[self.order[down, bottom], down]).sum())
        whole = anchor.astype(object)
        at = self.q.astype(object)
        return sum(whole[d] * at[self.order[d, top], d] for d in up) + sum(whole[d] * at[self.order[d, bottom], d] for d in down)


def _window(share: tuple[int, int] | None, score: int) -> tuple[int, int]:
    """The scores s with share[0] * score <= 100 * s <= share[1] * score; all of them without a share."""
    return (_LOW, _HIGH) if share is None else (-(-share[0] * score // 100), share[1] * score // 100)


def _searching(k: int, same: bool, share: tuple[int, int] | None):
    """The task: rows of blocks in order, a block's candidates (part 0) before the anchors (part 1)."""

    def lists(held) -> dict[int, Lists]:
        out = {}
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            q = t.column("q").combine_chunks()
            size = np.diff(q.offsets.to_numpy())
            flat, at = q.values.to_numpy(zero_copy_only=False), q.offsets.to_numpy()
            ids, labels = t.column("id").to_numpy(), t.column("label").to_numpy()
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                places = at[:-1][rows][:, None] + np.arange(d)
                out[int(d)] = Lists(ids[rows], labels[rows], flat[places])
        return out

    def run(batches):
        block, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cuts = shared._changes(batch, ["block", "part"])
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                piece = batch.slice(int(lo), int(hi - lo))
                if piece.column("block")[0].as_py() != block:
                    block, held, built = piece.column("block")[0].as_py(), [], None
                if piece.column("part")[0].as_py() == 0:
                    held.append(piece)
                    continue
                if built is None:
                    built, held = lists(held), []
                yield from answer(piece, built)

    def answer(piece, built):
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        for own, label, q, wanted in zip(*(piece.column(c).to_pylist() for c in ("id", "label", "q", "wanted")), strict=True):
            here = built.get(len(q))
            if here is not None and same:
                here = here.of_label(label)
            if here is None or not len(here.ids):
                continue
            may = here.ids != own
            if not same:
                may &= here.labels != label
            ends = [_window(share, w["score"]) for w in wanted]
            for w, (rows, scores) in zip(wanted, here.search(np.array(q, np.int64), may, *map(list, zip(*ends, strict=True)), k), strict=True):
                for column, value in zip(out, (own, w["name"], w["score"], here.ids[rows], scores), strict=True):
                    column.append(np.broadcast_to(value, len(rows)))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["id", "name", "given", "other", "score"])

    return run


def threshold_search(rows: DataFrame, anchors: DataFrame, k: int, same: bool, share: tuple[int, int] | None = None, n_blocks: int | None = None) -> DataFrame:
    """(id, name, given, other, score, rank): for each anchor and each of its `wanted` windows the first k of rows.

    rows (id, label, q); anchors (id, label, q, wanted: array of (name, score)). `same` searches the anchor's own label, else
    all others. share gives a window's ends in hundredths of its score. A block meets all anchors, so blocks x anchors rows are
    sent; rows themselves are dealt once.
    """
    if n_blocks is None:
        n_blocks = max(1, -(-rows.count() // BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64("id", "q"), F.lit(n_blocks)).cast("int").alias("block"), F.lit(0).alias("part"), "id", "label", "q", F.lit(None).cast("array<struct<name:long,score:long>>").alias("wanted"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(1).alias("part"), "id", "label", "q", "wanted")
    found = dealt.unionByName(asked).repartition(n_blocks, "block").sortWithinPartitions("block", "part").mapInArrow(_searching(k, same, share), _FOUND)
    place = Window.partitionBy("id", "name").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); see the head of this module.

    rows and anchors are (id long, label long, q array<long>); anchors are told by their id.
    """
    def sound(df):
        usable = df.where("id is not null and label is not null and q is not null").select("id", F.struct(F.col("label").cast("long").alias("label"), "q").alias("x"))
        return shared.stored(usable.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.q"))

    rows, one = sound(rows), sound(anchors)
    n_blocks = max(1, -(-rows.count() // BLOCK))
    any_score = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(0).cast("long").alias("score")))
    near = threshold_search(rows, one.withColumn("wanted", any_score), positives, True, n_blocks=n_blocks)
    wanted = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("other").alias("name"), "score"))).alias("wanted"))  # at most `positives`
    asked = shared.stored(one.join(wanted, "id"))
    far = threshold_search(rows, asked, negatives, False, share, n_blocks)
    names = {"id": "anchor_id", "name": "positive_id", "other": "negative_id", "given": "positive_score", "score": "negative_score"}
    return far.withColumnsRenamed(names).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose vec_id is divisible by 100, among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), quantised("embedding").alias("q"))
    return hard_negatives(rows, rows.where("id % 100 = 0"))
