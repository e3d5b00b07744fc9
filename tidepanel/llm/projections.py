"""Embedding near-dedup by collision-counting projections.

Every vector, scaled to length 1, is projected on m random lines. On each line vectors are sorted, and two collide there
if one lies in the window of half-width w centred on the other. A pair at the cosine threshold differs by a normal
variable of known spread on each line, so the number of its collisions is binomial; the least count is calibrated so
that such a pair passes with the target recall, and pairs that pass are verified by their cosine in double precision.

So that windows needn't be opened on whole lines, each of g tables first sorts the vectors into cells by a few lines of
its own and opens the windows within a cell; lines and tables are as many as the recall and the number of vectors ask
for. A pair is counted in the first table where it meets, so no table of pairs is made: tasks send each vector's number of
links and star edges. Equal vectors are one vertex beforehand.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import shared


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    recall: float = 0.9995
    half_window: float = 0.6
    cell: float = 2.0
    lines: int = 24
    block_rows: int = 1024
    block_pairs: int = 1 << 15
    seed: int = 17


def _phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def _same_cell(spread: float, cell: float) -> float:
    """Chance that two values whose difference is normal with this spread lie in one cell of a randomly shifted grid."""
    x = np.linspace(0, cell, 4001)
    y = 2 * np.exp(-0.5 * (x / spread) ** 2) / (spread * math.sqrt(2 * math.pi)) * (1 - x / cell)
    return float(np.sum((y[1:] + y[:-1]) / 2) * (x[1] - x[0]))


@dataclass(frozen=True)
class Plan:
    """Cells' lines, tables and least count for n vectors in the largest group."""

    per_table: int
    tables: int
    least: int

    @staticmethod
    def of(n: int, s: Settings) -> Plan:
        spread = math.sqrt(max(1e-12, 2 - 2 * s.threshold))
        window = 2 * _phi(s.half_window / spread) - 1
        near, far = _same_cell(spread, s.cell), _same_cell(math.sqrt(2), s.cell)
        per_table = min(24, max(1, math.ceil(math.log(max(2, n / 16)) / -math.log(far))))
        meets = near**per_table * window
        tables = max(1, math.ceil(math.log((1 - s.recall) / 2) / math.log(1 - meets)))
        least, missed = s.lines, 1.0
        while least > 0 and missed > (1 - s.recall) / 2:
            least -= 1
            missed = sum(math.comb(s.lines, k) * window**k * (1 - window) ** (s.lines - k) for k in range(least))
        return Plan(per_table, tables, least)


@lru_cache(maxsize=64)
def _directions(width: int, plan: Plan, s: Settings):
    """The counted lines, each table's sorted line, the lines of its cells, and the shifts of their grids."""
    rng = np.random.default_rng((s.seed, width))
    counted = rng.standard_normal((width, s.lines))
    lines = rng.standard_normal((width, plan.tables))
    axes = rng.standard_normal((width, plan.tables * plan.per_table))
    return counted, lines, axes, rng.random(plan.tables * plan.per_table)


def _projected(x: np.ndarray, plan: Plan, s: Settings):
    """Positions on the counted lines and on each table's sorted line, and the cell of each table."""
    counted, lines, axes, shift = _directions(x.shape[1], plan, s)
    place = np.floor(x @ axes / s.cell + shift).astype(np.int64).view(np.uint64).reshape(len(x), plan.tables, plan.per_table)
    cells = np.broadcast_to(np.arange(1, plan.tables + 1, dtype=np.uint64), (len(x), plan.tables))
    for k in range(plan.per_table):
        cells = shared.mixed(cells ^ place[:, :, k])
    return x @ counted, x @ lines, cells


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(vectors: DataFrame, s: Settings | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors (vec_id, embedding, label).

    Links hold between vectors of one label and one length whose cosine reaches the threshold. Rows with a null id, a null
    label, or a vector that is null, empty, zero or holds null or non-finite components link with nothing; their
    component is their own id. Repeated rows are vectors of their own that link with each other.
    """
    s = s or Settings()
    spark = vectors.sparkSession
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType, ArrayType) and isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "f8"
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & finite & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    keyed = rows.where("usable").withColumn("vertex", F.xxhash64("embedding", "label")).withColumn("second", F.hash("label", "embedding"))
    classes = shared.stored(keyed.groupBy("vertex", "second").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding")).withColumn("width", F.size("embedding")))
    largest = classes.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    plan = Plan.of(int(largest), s)

    def placed(batches):
        for batch in batches:
            widths = batch.column(4).to_numpy()
            for width in np.unique(widths):
                part = batch.filter(pa.array(widths == width))
                x = part.column(3).flatten().to_numpy().astype(kind).reshape(len(part), width)
                _, _, cells = _projected(_unit(x), plan, s)
                packed = shared.binary(x)
                for g in range(plan.tables):
                    tables = pa.array(np.full(len(part), g, np.int32))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], part.column(4), tables, pa.array(cells[:, g].view(np.int64)), packed], names=["label", "vertex", "copies", "width", "table", "cell", "vector"])

    met = classes.select("label", "vertex", "copies", "embedding", "width").mapInArrow(placed, "label string, vertex long, copies long, width int, table int, cell long, vector binary")
    keys = ["label", "width", "table", "cell"]
    sizes = met.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    dealt = shared.dealt_blocks(met.join(sizes, keys), keys, "vertex", "size", s.block_rows)

    def compared(batches):
        for batch, cuts in shared.groups(batches, [*keys, "b1", "b2"]):
            ids, copies, home, b1, b2, table, width = (batch.column(c).to_numpy() for c in ("vertex", "copies", "home", "b1", "b2", "table", "width"))
            column = batch.column("vector")
            out = [[], [], []]
            # rows of one width are projected together, for all their groups
            runs = cuts[np.flatnonzero(np.concatenate([[True], width[cuts[1:-1]] != width[cuts[1:-1] - 1]]))]
            for first, end in zip(runs.tolist(), [*runs[1:].tolist(), len(ids)], strict=True):
                x = _unit(shared.fixed(column.slice(first, end - first), kind).reshape(end - first, int(width[first])))
                seen = _projected(x, plan, s)
                inner = cuts[(cuts >= first) & (cuts <= end)]
                for lo, hi in zip(inner[:-1].tolist(), inner[1:].tolist(), strict=True):
                    if hi - lo < 2:
                        continue
                    own = slice(lo - first, hi - first)
                    i, j = _linked(x[own], *(v[own] for v in seen), int(table[lo]), plan, s)
                    if b1[lo] != b2[lo]:
                        apart = home[lo + i] != home[lo + j]
                        i, j = i[apart], j[apart]
                    if not len(i):
                        continue
                    links = np.bincount(i, copies[lo + j], hi - lo) + np.bincount(j, copies[lo + i], hi - lo)
                    has = np.flatnonzero(links)
                    out[0].append(ids[lo + has])
                    out[1].append(links[has].astype(np.int64))
                    out[2].append(ids[lo + shared.pair_roots(i, j, hi - lo)[has]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *v])) for v in out], names=["vertex", "links", "root"])

    found = shared.stored(dealt.select(*keys, "b1", "b2", "home", "vertex", "copies", "vector").mapInArrow(compared, "vertex long, links long, root long"))
    parts = shared.components(found.select(F.col("vertex").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "part")
    least = classes.join(parts, "vertex").groupBy("part").agg(F.min("rep").alias("component_id"))
    counts = found.groupBy("vertex").agg(F.sum("links").alias("links"))
    known = (
        classes.select("vertex", "second", "rep", "copies").join(parts, "vertex", "left").join(least, "part", "left").join(counts, "vertex", "left")
        .select("vertex", "second", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    good = keyed.select("vec_id", "vertex", "second").join(known, ["vertex", "second"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(x: np.ndarray, counted: np.ndarray, lines: np.ndarray, cells: np.ndarray, table: int, plan: Plan, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's vectors that collide often enough, are close, and didn't meet in an earlier table."""
    n = len(x)
    order = np.argsort(lines[:, table])
    position = lines[order, table]
    # windows on the sorted line: how many of those after each vector lie within half_window
    ahead = np.searchsorted(position, position + s.half_window + 1e-9, "right") - np.arange(1, n + 1)
    ends = np.cumsum(ahead)
    found = [[], []]
    lo = 0
    while lo < n:
        # some vectors' windows at a time, so that memory is bounded however dense the cell is
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - ahead[lo] + s.block_pairs, "right")))
        i = np.repeat(np.arange(lo, hi), ahead[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[lo:hi] - ahead[lo:hi] - (ends[lo] - ahead[lo]), ahead[lo:hi])
        i, j = order[i], order[j]
        lo = hi
        near = np.abs(lines[i, table] - lines[j, table]) <= s.half_window
        i, j = i[near], j[near]
        for test in (
            lambda i, j: (np.abs(counted[i] - counted[j]) <= s.half_window).sum(1) >= plan.least,
            lambda i, j: np.einsum("ij,ij->i", x[i], x[j]) >= s.threshold,
            lambda i, j: ~((cells[i, :table] == cells[j, :table]) & (np.abs(lines[i, :table] - lines[j, :table]) <= s.half_window)).any(1),
        ):
            if not len(i):
                break
            good = test(i, j)
            i, j = i[good], j[good]
        found[0].append(i)
        found[1].append(j)
    return np.concatenate(found[0]), np.concatenate(found[1])


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector of embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
