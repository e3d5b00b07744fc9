"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted shingles.

A window of as many words as an item has gets a 64-bit SimHash of its weighted words. The items' fingerprints are cut
into 8 blocks of 8 bits; two fingerprints within 22 bits agree in some block to within 2 bits, so looking up a block's
value and its 36 neighbours finds every item within the radius. Candidates within it are verified by the exact
similarity: the weight of the item's five-word shingles that stand in the window, over the weight of all of them.
Weights fall with the number of items a word or shingle occurs in.

A window without any shingle of an item has similarity 0 with it, so only windows that meet one are fingerprinted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WIDTH = 5
BLOCKS = 8


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8
    radius: int = 22
    #: Most items of one broadcast; larger benchmarks are searched in slices of this many, one pass over the texts each.
    most_items: int = 20_000


def _weight(df: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.log(np.maximum(df, 1)))


def _signs(words: np.ndarray) -> np.ndarray:
    """64 signs of each word's hash."""
    bits = np.unpackbits(shared.mixed(words ^ np.uint64(0x5DEECE66D)).view(np.uint8).reshape(len(words), 8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def items_table(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words, shingles) of each item with five words or more; words and shingles are hashes in order."""

    def run(batches):
        for batch in batches:
            ids, words, sets = [], [], []
            for lo, hi, data, at in shared.text_slices(batch.column(1)):
                low = shared.lowered(data)
                starts, ends, owner = shared.word_spans(low, at, shared.PLAIN)
                h = shared.span_hashes(low, starts, ends)
                for k in range(hi - lo):
                    own = h[owner == k]
                    if len(own) >= WIDTH:
                        ids.append(batch.column(0)[lo + k].as_py())
                        words.append(own.view(np.int64))
                        sets.append(np.unique(shared.shingles(own, np.zeros(len(own), int), WIDTH)[0]).view(np.int64))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, kind), pa.array(sets, kind)], names=["item", "words", "shingles"])

    return benchmark.select(F.col(item).cast("long"), F.col(text)).where(F.col(item).isNotNull()).mapInArrow(run, "item long, words array<long>, shingles array<long>")


@dataclass
class Index:
    """A slice of the benchmark, ready to search. All arrays are as large as the slice."""

    items: np.ndarray
    sizes: np.ndarray
    prints: np.ndarray  # n x 8 bytes
    sets: list[np.ndarray]
    set_weights: list[np.ndarray]
    words: np.ndarray
    word_weights: np.ndarray
    shingles: np.ndarray
    owners: list[np.ndarray]
    sieve: np.ndarray
    shift: int
    blocks: list[list[np.ndarray]]


def _index(rows: list, word_df: dict[int, int], shingle_df: dict[int, int], s: Settings) -> Index:
    words = np.array(sorted(word_df), np.int64).view(np.uint64)
    weights = _weight(np.array([word_df[int(x)] for x in words.view(np.int64)], float))
    order = np.argsort(words)
    words, weights = words[order], weights[order]
    prints, sets, set_weights, sizes, owner = [], [], [], [], {}
    for k, (_, w, sh) in enumerate(rows):
        w = np.array(w, np.int64).view(np.uint64)
        sums = (_signs(w) * weights[np.searchsorted(words, w)][:, None]).sum(0, keepdims=True)
        prints.append(_packed(sums)[0])
        sizes.append(len(w))
        sets.append(np.array(sh, np.int64).view(np.uint64))
        set_weights.append(_weight(np.array([shingle_df[x] for x in sh], float)))
        for x in sh:
            owner.setdefault(x, []).append(k)
    shingles = np.array(sorted(owner), np.int64).view(np.uint64)
    order = np.argsort(shingles)
    shingles = shingles[order]
    owners = [np.array(owner[int(x)]) for x in shingles.view(np.int64)]
    bits = max(12, int(np.ceil(np.log2(max(1, len(shingles)) * 32))))
    sieve = np.zeros(1 << bits, bool)
    sieve[shingles >> np.uint64(64 - bits)] = True
    prints = np.array(prints, np.uint8).reshape(len(rows), 8)
    most = s.radius // BLOCKS  # some block differs by at most so many bits
    near = [[u for u in range(256) if _ONES[u ^ v] <= most] for v in range(256)]
    blocks = [[np.flatnonzero(np.isin(prints[:, b], near[v])) for v in range(256)] for b in range(BLOCKS)]
    return Index(np.array([r[0] for r in rows]), np.array(sizes), prints, sets, set_weights, words, weights, shingles, owners, sieve, 64 - bits, blocks)


_ONES = np.array([bin(v).count("1") for v in range(256)], np.uint8)


def _within(x: Index, prints: np.ndarray, size: int, s: Settings) -> list[tuple[int, int, int]]:
    """(window, item, distance) of items of that size within the radius, by the multi-index."""
    found = []
    values, back = np.unique(prints, axis=0, return_inverse=True)
    for k, row in enumerate(values):
        near = np.unique(np.concatenate([x.blocks[b][row[b]] for b in range(BLOCKS)]))
        near = near[x.sizes[near] == size]
        if len(near):
            far = _ONES[x.prints[near] ^ row].sum(1)
            for i, d in zip(near[far <= s.radius].tolist(), far[far <= s.radius].tolist(), strict=True):
                found.extend((int(w), i, int(d)) for w in np.flatnonzero(back.reshape(-1) == k))
    return found


def _matches(x: Index, words: np.ndarray, grams: np.ndarray, s: Settings) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, distance, first word, last word) of the best window of each item that a text holds."""
    hit = np.flatnonzero(x.sieve[grams >> np.uint64(x.shift)])
    if not len(hit):
        return []
    at = np.searchsorted(x.shingles, grams[hit])
    real = (at < len(x.shingles)) & (x.shingles[np.minimum(at, len(x.shingles) - 1)] == grams[hit])
    hit, at = hit[real], at[real]
    if not len(hit):
        return []
    spots: dict[int, list[int]] = {}
    for p, k in zip(hit.tolist(), at.tolist(), strict=True):
        for i in x.owners[k].tolist():
            spots.setdefault(int(x.sizes[i]), []).append(p)
    n, best = len(words), {}
    for size, where in spots.items():
        where = sorted(set(where))
        spans: list[list[int]] = []
        for p in where:  # windows of this size that hold the shingle at p; texts shorter than the item are one window
            lo, hi = max(0, p + WIDTH - size), min(p, max(0, n - size))
            if spans and lo <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([min(lo, hi), hi])
        for lo, hi in spans:
            part = words[lo : hi + size]
            k = np.searchsorted(x.words, part)
            k = np.minimum(k, len(x.words) - 1)
            weight = np.where(x.words[k] == part, x.word_weights[k], 1.0).astype(np.float32)
            total = np.zeros((len(part) + 1, 64))
            np.cumsum(_signs(part) * weight[:, None], axis=0, out=total[1:])
            m = hi - lo + 1
            ends = np.minimum(np.arange(m) + size, len(part))
            for w, i, d in _within(x, _packed(total[ends] - total[:m]), size, s):
                first = lo + w
                there = grams[first : max(first, min(first + size, n) - WIDTH + 1)]
                inside = np.isin(x.sets[i], there)
                similar = float(x.set_weights[i][inside].sum() / x.set_weights[i].sum())
                if similar >= s.similarity - 1e-12 and (i not in best or (-similar, d, first) < best[i][0]):
                    best[i] = ((-similar, d, first), (int(x.items[i]), similar, d, first, min(first + size, n) - 1))
    return [v for _, v in best.values()]


def _searched(texts, x: Index, s: Settings):
    """Matches of each text of an Arrow column."""
    out: list[list] = [[] for _ in range(len(texts))]
    for lo, _, data, at in shared.text_slices(texts):
        low = shared.lowered(data)
        starts, ends, owner = shared.word_spans(low, at, shared.PLAIN)
        words = shared.span_hashes(low, starts, ends)
        rolled, whose = shared.shingles(words, owner, WIDTH)
        may = np.unique(whose[x.sieve[rolled >> np.uint64(x.shift)]])
        for k in may.tolist():
            a, b = np.searchsorted(owner, [k, k + 1])
            c, d = np.searchsorted(whose, [k, k + 1])
            out[lo + k] = _matches(x, words[a:b], rolled[c:d], s)
    return out


def _slices(benchmark: DataFrame, s: Settings):
    """Indexes of the benchmark, one for each most_items items."""
    table = shared.stored(items_table(benchmark))
    n = table.count()
    parts = -(-n // s.most_items)
    part = F.pmod(F.xxhash64("item"), F.lit(max(1, parts)))
    frequency = {c: table.select("item", F.explode(c).alias("h")).distinct().groupBy("h").count() for c in ("words", "shingles")}
    for p in range(parts):
        own = table.where(part == p)
        df = {c: dict(own.select(F.explode(c).alias("h")).distinct().join(frequency[c], "h").collect()) for c in frequency}
        yield _index(sorted(map(tuple, own.dropDuplicates(["item"]).collect())), df["words"], df["shingles"], s)


def contaminated(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """(doc_id, item_id, similarity, distance, first_word, last_word) of the best window of each item in each document.

    Null or empty texts, and items with fewer than five words, match nothing. Repeated documents each have their rows;
    an item id that occurs twice counts once.
    """
    s = s or Settings()
    names = ["doc_id", "item_id", "similarity", "distance", "first_word", "last_word"]
    schema = "doc_id long, item_id long, similarity double, distance int, first_word long, last_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _slices(benchmark, s):
        shipped = docs.sparkSession.sparkContext.broadcast(index)  # at most most_items items

        def run(batches, shipped=shipped):
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(i, *m) for i, found in zip(ids, _searched(batch.column(1), shipped.value, s), strict=True) for m in found]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings | None = None) -> DataFrame:
    """The documents that hold no item, with their columns."""
    s = s or Settings()
    for index in _slices(benchmark, s):
        shipped = docs.sparkSession.sparkContext.broadcast(index)  # at most most_items items
        at = docs.columns.index("text")

        def run(batches, shipped=shipped, at=at):
            for batch in batches:
                yield batch.filter(pa.array([not m for m in _searched(batch.column(at), shipped.value, s)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every item of benchmark found in every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without benchmark items."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
