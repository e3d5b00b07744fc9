"""Quality classifier: importance resampling with hashed n-gram models.

Two generative models over hashed byte n-grams, one of target text (labelled good) and one of raw text (all documents),
give every document a log importance weight, log p_target - log p_raw, here per n-gram so that length doesn't decide;
`prior` n-grams of ratio 0 draw the weights of very short texts to 0. Besides the byte n-grams there is one n-gram for each
word: which of three neighbouring words repeat the one before, so that texts that say one word again and again show.
Gumbel noise is added to the weights and the k documents of the largest keys are the resample: drawing without
replacement in proportion to the weights (Gumbel top-k). The weights are divided by a temperature first; k is the
number of documents whose weight reaches the border that best parts the labelled rows.

Target rows come from a bounded sample of labels (parameter most_labels); the raw model, the weights, k and the cut
cover every document. The models are two vectors of 2**bits counts, whatever the input's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Settings:
    bits: int = 16
    width: int = 3
    most_labels: int = 20_000
    #: Of the Gumbel noise against the document's log ratio: 1 draws by the importance weights themselves.
    temperature: float = 1.0
    seed: int = 7
    prior: float = 60.0

    @property
    def size(self) -> int:
        return (1 << self.bits) + 8


def _buckets(data: np.ndarray, at: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of a slice, and the text of each."""
    n = len(data) - s.width + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint32)
    for k in range(s.width):
        code = code * np.uint32(257) + data[k : k + n]
    code = (code * np.uint32(2654435761)) >> np.uint32(32 - s.bits)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = owner[:n] == owner[s.width - 1 :]
    starts, ends, text = shared.word_spans(data, at, shared.SPACED)
    words = shared.span_hashes(data, starts, ends)
    same = np.zeros(len(words) + 2, np.uint32)
    same[3:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1]) if len(words) else 0
    repeats = np.uint32(1 << s.bits) + same[2:] + 2 * same[1:-1] + 4 * same[:-2]
    return np.concatenate([code[whole], repeats]), np.concatenate([owner[:n][whole], text])


def _counts(docs: DataFrame, text: str, s: Settings) -> np.ndarray:
    """How often each bucket occurs; each task sends one vector, summed by bucket. Bounded by 2**bits rows."""

    def run(batches):
        total = np.zeros(s.size, np.int64)
        for batch in batches:
            for _, _, data, at in shared.text_slices(batch.column(0)):
                total += np.bincount(_buckets(data, at, s)[0], minlength=s.size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(s.size)
    for b, n in docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).toPandas().to_numpy():
        out[int(b)] = n
    return out


@dataclass(frozen=True)
class Model:
    ratio: np.ndarray
    border: float
    cut: float = -np.inf


def weights(docs: DataFrame, model: Model, s: Settings, text: str = "text", only_kept: bool = False) -> DataFrame:
    """docs plus `weight` (log ratio), `key` (weight over temperature plus Gumbel noise) and `keep`.

    The weight is the text's log ratio of target to raw model, with the border for each n-gram as the models' log prior.

    A text of no n-gram (null, empty, under `width` bytes) has a null weight and isn't kept. With only_kept the rows
    not kept go, and so do the three columns.
    """
    kept = docs.drop("weight", "key", "keep")
    ratio = docs.sparkSession.sparkContext.broadcast(model.ratio)  # 2**bits doubles
    names, cut = kept.columns, model.cut
    noised = kept.withColumn(*shared.free_names(names, "noise"), F.pmod(F.xxhash64(F.col("doc_id"), F.lit(s.seed)), F.lit(1 << 52)))
    schema = kept.schema if only_kept else shared.widened(kept, "weight double, key double, keep boolean")

    def run(batches):
        for batch in batches:
            weight = np.full(batch.num_rows, np.nan)
            for lo, hi, data, at in shared.text_slices(batch.column(names.index(text))):
                code, owner = _buckets(data, at, s)
                n = np.bincount(owner, minlength=hi - lo)
                total = np.bincount(owner, ratio.value[code], minlength=hi - lo)
                weight[lo:hi] = np.where(n > 0, total - model.border * (n + s.prior), np.nan)
            u = (batch.column(len(names)).fill_null(0).to_numpy(zero_copy_only=False) + 0.5) / (1 << 52)
            key = weight / s.temperature - np.log(-np.log(u))
            keep = np.nan_to_num(key, nan=-np.inf) >= cut
            keep &= ~np.isnan(weight)
            columns = batch.columns[: len(names)]
            if only_kept:
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))
            else:
                none = np.isnan(weight)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(weight, mask=none), pa.array(key, mask=none), pa.array(keep)], names=[*names, "weight", "key", "keep"])

    return noised.mapInArrow(run, schema)


def _border(weight: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap between labelled good and bad weights that makes the fewest errors, good ones doubled."""
    order = np.argsort(weight)
    w, g = weight[order], good[order]
    if not len(w) or g.all() or not g.any():
        return -np.inf
    errors = np.concatenate([[0], np.cumsum(np.where(g, 2.0, 0.0))]) + np.concatenate([np.cumsum(np.where(~g, 1.0, 0.0)[::-1])[::-1], [0]])
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    lo = w[k - 1] if k else w[0] - 1
    hi = w[k] if k < len(w) else w[-1] + 1
    return float((lo + hi) / 2)


def kth_largest(rows: DataFrame, key: str, k: int, most: int = 20_000) -> float:
    """The k-th largest value of a double column, exactly: counts over ever finer ranges, until few values are left."""
    rows = rows.where(F.col(key).isNotNull())
    lo, hi, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return np.inf
    if k >= n:
        return float(lo)
    parts = 4096
    while n > most and hi > lo:
        step = (hi - lo) / parts
        place = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(step)), F.lit(parts - 1)).alias("p")
        found = rows.where(F.col(key).between(lo, hi)).groupBy(place).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for _, count, low, high in sorted(map(tuple, found.collect()), reverse=True):  # at most 4,096 rows
            if k <= count:
                n, lo, hi = count, low, high
                break
            k -= count
    values = sorted((r[0] for r in rows.where(F.col(key).between(lo, hi)).select(key).limit(most + 1).collect()), reverse=True) if hi > lo else [lo] * k
    return float(values[k - 1])


def fit(docs: DataFrame, labels: DataFrame, s: Settings | None = None, text: str = "text") -> Model:
    """Both models, the border and the cut of the resample. labels: doc_id, quality (0 or 1; null rows don't count).

    As many documents are drawn as have a log ratio over 0, those of the largest keys; documents tied with the last one are
    kept too. Without labels of both kinds there is nothing to tell apart: every text with an n-gram is kept.
    """
    s = s or Settings()
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    few = shared.bounded_sample(marked, "doc_id", s.most_labels).withColumnsRenamed({"doc_id": "marked_id", "quality": "marked"})
    few = shared.stored(few)  # at most most_labels rows of 12 bytes, so the join may send it to every executor
    own = docs.select("doc_id", text)
    sample = own.join(F.broadcast(few), own.doc_id == few.marked_id).select("doc_id", text, "marked")
    raw, target = _counts(docs, text, s), _counts(sample.where("marked = 1"), text, s)
    size = s.size
    ratio = np.log((target + 1) / (target.sum() + size)) - np.log((raw + 1) / (raw.sum() + size))
    sizes = F.greatest(F.octet_length(text) - (s.width - 1), F.lit(0)) + F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))
    scored = weights(sample, Model(ratio, 0.0), s, text).where("weight is not null").select((F.col("weight") / (sizes + s.prior)).alias("each"), "marked").toPandas()  # at most most_labels rows
    border = _border(scored.each.to_numpy(float), scored.marked.to_numpy() == 1)
    if not np.isfinite(border):
        return Model(ratio, 0.0)
    model = Model(ratio, border)
    keys = shared.stored(weights(own, model, s, text).select("weight", "key"))
    k = keys.where("weight >= 0").count()
    return Model(ratio, border, kth_largest(keys, "key", k))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Weight, Gumbel key and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    s = Settings()
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), s)
    return weights(docs, model, s).select("doc_id", "weight", "key", "keep")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the resample keeps, with their columns."""
    s = Settings()
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), s)
    return weights(docs, model, s, only_kept=True)
