"""Helpers that several training-data operators use: shared storage, components, blocks of pairs, word arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# ------------------------------------------------------------------ storage


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only where it is unset and Spark is local."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage, survives lost executors.

    With `by` the table is bucketed by that column, so joins and groups on it don't shuffle its rows again.
    """
    spark, name = df.sparkSession, f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    out = df.write.option("compression", "zstd")
    if by is None:
        out.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    out.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).format("parquet").saveAsTable(name)
    back = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay in the shared folder
    return back


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be none of the columns."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# -------------------------------------------------------------------- joins


def spread_join(many: DataFrame, one: DataFrame, key: str, weight: str, spread: list[str], heaviest: int = 1000, total: int | None = None) -> DataFrame:
    """Inner join of many with one, which holds a row per key, where a key may hold any share of many's rows.

    one's column `weight` is at least the number of many's rows of the key. Keys over a share of 1 / 10,000 of all weight
    (and over `heaviest` rows) are at most 10,000; they are broadcast, and their rows are dealt over the partitions by a hash
    of the columns `spread`. All other keys meet in an ordinary join.
    """
    total = (one.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    hot = F.col(weight) > max(heaviest, total // 10_000)
    values = [c for c in one.columns if c not in (key, weight)]
    found, lighter, salt = free_names([*many.columns, *one.columns], "found", "lighter", "salt")
    heavy = one.where(hot).select(key, F.struct(*values).alias(found))
    marked = many.join(F.broadcast(heavy), key, "left")
    marked = marked.withColumn(salt, F.when(F.col(found).isNotNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(100_000))).otherwise(F.lit(0).cast("bigint")))
    light = one.where(~hot).select(key, weight, F.struct(*values).alias(lighter), F.lit(0).cast("bigint").alias(salt))
    out = marked.join(light, [key, salt], "left").withColumn(found, F.coalesce(found, lighter)).where(F.col(found).isNotNull())
    carried = [c for c in many.columns if c not in values]
    return out.select(*carried, *(F.col(f"{found}.{c}").alias(c) for c in values))


# --------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, component) for undirected edges (a, b) of longs; component is the smallest vertex reachable.

    Alternating large-star and small-star steps: every vertex hands its larger neighbours to its smallest one, until
    the edge set stands still. Each step only groups and joins; a hub's edges are spread over the partitions, and what one
    round leaves is stored in the shared folder. Vertices without an edge to another vertex are not returned.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = seen = _mark(now)
    for _ in range(most_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, "u", "n", ["v"], total=2 * seen[0]).where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, root, "hi", "n", ["lo"], total=seen[0]).select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        now = stored(small.select("e.hi", "e.lo").where("hi <> lo").distinct())
        seen = _mark(now)
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components did not settle")
    stars = now.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "vertex")
    return stars.unionByName(stars.select(F.col("component").alias("vertex"), "component").distinct())


def _mark(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first())


# ---------------------------------------------------------- blocks of pairs


def dealt_blocks(df: DataFrame, keys: list[str], id_col: str, size: str, rows: int) -> DataFrame:
    """Deal the rows of each key into tasks of at most 2 * rows rows that together hold every pair of rows once.

    A key of up to `rows` rows (column `size`) is one task. A larger one is cut into blocks by a hash of the id, and
    each row goes to the task of its own block and to those of its block with each other one. Adds b1, b2 and home;
    partitions by the task and sorts by it.
    """
    blocks = F.ceil(F.col(size) / F.lit(rows)).cast("int")
    home = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    out = df.withColumn("blocks", blocks).withColumn("home", home).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    out = out.withColumn("b1", F.least("home", "other")).withColumn("b2", F.greatest("home", "other")).drop("other", "blocks")
    task = [*keys, "b1", "b2"]
    return out.repartition(*task).sortWithinPartitions(*task)


def groups(batches, keys: list[str]):
    """Yield (table, bounds) from sorted Arrow batches: bounds cut the table into whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changes = _changes(batch, keys)
        if held and not _same(held[-1], batch, keys):
            yield _whole(held, keys)
            held = []
        if len(changes):
            held.append(batch.slice(0, int(changes[-1])))
            yield _whole(held, keys)
            held = [batch.slice(int(changes[-1]))]
        else:
            held.append(batch)
    if held:
        yield _whole(held, keys)


def _column(batch, key) -> np.ndarray:
    return batch.column(key).to_numpy(zero_copy_only=False)


def _changes(batch, keys) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        x = _column(batch, k)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _same(a, b, keys) -> bool:
    return all(a.column(k)[a.num_rows - 1] == b.column(k)[0] for k in keys)


def _whole(held, keys):
    table = pa.Table.from_batches(held).combine_chunks()
    batch = table.to_batches()[0]
    return batch, np.concatenate([[0], _changes(batch, keys), [batch.num_rows]])


def fixed(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of values of one width as a matrix, one row each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.ascontiguousarray(data).view(kind).reshape(len(column), -1)


def binary(matrix: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * (matrix.shape[1] if matrix.ndim > 1 else 1)
    at = np.arange(len(matrix) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(matrix.tobytes())])


def roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the smallest row reachable."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pair_roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows, the smallest row reachable by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


# -------------------------------------------------------------- word arrays

#: Byte classes. Words of letters, digits and all bytes over 127; words cut at white space alone.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 2**64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most_bytes: int = 1 << 19):
    """Cut a string column into slices of about most_bytes of UTF-8 (a longer text is a slice of its own).

    Yields (first row, last row + 1, bytes, offsets); nulls count as empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type):
        kind, step = np.int64, 8
    else:
        kind, step = np.int32, 4
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], kind, n + 1, column.offset * step).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most_bytes, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and text numbers of the words of a slice; `word` says which bytes belong to words."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same for the same bytes wherever they stand."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_of(text: str) -> int:
    """span_hashes of one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingles(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `width` words within a text, and the text; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return words, owner
    mult = np.uint64(_BASE)
    rolled = words.copy()
    for k in range(1, width):
        rolled[: n - k] = rolled[: n - k] * mult + words[k:] if n > k else rolled[: n - k]
    whole = np.zeros(n, bool)
    if n >= width:
        whole[: n - width + 1] = owner[: n - width + 1] == owner[width - 1 :]
    first = np.ones(n, bool)
    first[1:] = owner[1:] != owner[:-1]
    head = np.flatnonzero(first)
    short = head[np.diff(np.append(head, n)) < width]
    for i in short:
        j = i
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            while j < n and owner[j] == owner[i]:
                h = h * mult + words[j]
                j += 1
        rolled[i] = h
        whole[i] = True
    keep = np.flatnonzero(whole)
    return mixed(rolled[keep]), owner[keep]


def class_spans(data: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for runs of bytes of one kind; kind 0 separates."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    kind = kinds[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    edges = np.flatnonzero(new)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    return starts[keep], ends[keep], np.searchsorted(at, starts[keep], "right") - 1


def bounded_sample(rows: DataFrame, id_col: str, most: int, seed: int = 11) -> DataFrame:
    """At most `most` rows, those with the smallest hash of their id: the same ones on every run.

    A threshold on the hash leaves about twice as many rows as wanted first, so tasks send few rows however many there are.
    """
    n = rows.count()
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 40))
    few = rows.where(place < int((1 << 40) * min(1.0, (2 * most + 1000) / max(n, 1))))
    return few.orderBy(place, id_col).limit(most)


def widened(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with further columns."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def lowered(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 in lower case."""
    low = LOWER[data]
    if len(low) > 1:
        capital = (low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)
        low[1:][capital] += 0x20
    return low
