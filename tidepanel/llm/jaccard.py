"""N-gram Jaccard join by a MinHash LSH forest.

A document is the set of its five-word shingles. Each of the forest's trees labels it with its own sequence of
MinHashes; in a tree, sorted by label, documents meet when their labels share a prefix. A pair of similarity t shares
a prefix of d values in some of L trees with probability 1 - (1 - t**d)**L, so the matched prefix is shortened from the
full label until that reaches the target recall; where the trie is sparse (a node of few documents) it's shortened by one
value more, which only adds recall.

Documents with the same words are one class beforehand, so a group of copies of any size is one vertex. Within a node,
pairs are compared by all their MinHashes, one byte each, and those that agree too seldom for the threshold go; what
is left ties candidates into components, whose members then are compared exactly by their whole shingle sets. Both
steps work on blocks of pairs of bounded size and send counts and star edges, never pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    width: int = 5
    trees: int = 16
    longest: int = 8
    recall: float = 0.998
    sparse: int = 64
    node_rows: int = 1024
    set_rows: int = 384
    seed: int = 3

    @property
    def depth(self) -> int:
        """The longest prefix at which pairs at the threshold are met with the target recall."""
        for d in range(self.longest, 1, -1):
            if 1 - (1 - self.threshold**d) ** self.trees >= self.recall:
                return d
        return 1

    @property
    def least_agreeing(self) -> int:
        """MinHashes of a pair that must agree: 5 standard deviations under what the threshold gives."""
        n, t = self.trees * self.depth, self.threshold
        return max(1, math.floor(n * t - 5 * math.sqrt(n * t * (1 - t))))


def _sets(column, s: Settings):
    """For each slice of texts: first row, number of rows, words, owners of words, shingles, owners of shingles."""
    for lo, hi, data, at in shared.text_slices(column):
        low = shared.lowered(data)
        starts, ends, owner = shared.word_spans(low, at, shared.PLAIN)
        words = shared.span_hashes(low, starts, ends)
        grams, whose = shared.shingles(words, owner, s.width)
        yield lo, hi - lo, words, owner, grams, whose


def _class_keys(words: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key per text of its word sequence (0 for texts without words)."""
    key = np.zeros(n, np.uint64)
    if len(words):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        place = (np.arange(len(words)) - np.repeat(first, np.diff(np.append(first, len(words))))).astype(np.uint64)
        key[owner[first]] = shared.mixed(np.add.reduceat(shared.mixed(words + place * np.uint64(0xD6E8FEB86659FD93)), first))
    return key


def signatures(docs: DataFrame, s: Settings, text: str = "text") -> DataFrame:
    """(doc_id, vertex, bytes, nodes, deeper): class key, a byte of each MinHash, and each tree's two prefix hashes."""
    depth, n_hashes = s.depth, s.trees * s.depth
    rng = np.random.default_rng(s.seed)
    factors = rng.integers(0, 2**63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(0, 2**63, n_hashes, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            for lo, n, words, owner, grams, whose in _sets(batch.column(1), s):
                key = _class_keys(words, owner, n)
                low = np.full((n_hashes, n), np.iinfo(np.uint64).max, np.uint64)
                if len(grams):
                    first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
                    for k in range(n_hashes):
                        low[k, whose[first]] = np.minimum.reduceat(grams * factors[k] + offsets[k], first)
                tags = (shared.mixed(low) >> np.uint64(56)).astype(np.uint8).T
                nodes, deeper = np.zeros((n, s.trees), np.uint64), np.zeros((n, s.trees), np.uint64)
                for t in range(s.trees):
                    h = np.full(n, np.uint64(t + 1))
                    for d in range(depth):
                        if d == max(1, depth - 1):
                            nodes[:, t] = h
                        h = shared.mixed(h ^ low[t * depth + d])
                    if depth == 1:
                        nodes[:, t] = h
                    deeper[:, t] = h
                keep = key != 0
                ids = batch.column(0).slice(lo, n).filter(pa.array(keep))
                at = pa.array((np.arange(keep.sum() + 1) * s.trees).astype(np.int32))
                longs = [pa.ListArray.from_arrays(at, pa.array(x[keep].view(np.int64).reshape(-1))) for x in (nodes, deeper)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(key[keep].view(np.int64)), shared.binary(tags[keep]), *longs], names=["doc_id", "vertex", "tags", "nodes", "deeper"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, vertex long, tags binary, nodes array<long>, deeper array<long>")


def _agreeing(classes: DataFrame, s: Settings) -> DataFrame:
    """Star edges (a, b) between vertices that meet in a node of some tree and agree often enough."""
    met = classes.select("vertex", F.posexplode(F.arrays_zip("nodes", "deeper")).alias("tree", "at")).select("vertex", "tree", "at.nodes", "at.deeper")
    deep = met.groupBy("tree", "nodes", "deeper").agg(F.count("*").alias("n"))
    whole = deep.groupBy("tree", "nodes").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    sparse = whole.where(F.col("all") <= s.sparse).withColumnRenamed("all", "size")
    # a dense node is taken apart by one more value; its parts of one vertex have no pair
    dense = deep.where(F.col("n") > 1).join(whole.where(F.col("all") > s.sparse), ["tree", "nodes"]).select("tree", "nodes", "deeper", F.col("n").alias("size"))
    by_node = met.join(sparse, ["tree", "nodes"]).select("vertex", F.col("nodes").alias("node"), "size")
    by_part = met.join(dense, ["tree", "nodes", "deeper"]).select("vertex", F.col("deeper").alias("node"), "size")
    # the signatures join once it's known which vertices share a node
    shared_nodes = by_node.unionByName(by_part).join(classes.select("vertex", "tags"), "vertex")
    dealt = shared.dealt_blocks(shared_nodes, ["node"], "vertex", "size", s.node_rows)
    least = s.least_agreeing

    def run(batches):
        for batch, cuts in shared.groups(batches, ["node", "b1", "b2"]):
            ids = batch.column("vertex").to_numpy()
            tags = shared.fixed(batch.column("tags"), np.uint8)
            home, b1, b2 = (batch.column(c).to_numpy() for c in ("home", "b1", "b2"))
            a, b = [], []
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                own, sub = ids[lo:hi], tags[lo:hi]
                if hi - lo == 2:
                    if (sub[0] == sub[1]).sum() >= least:
                        a.append(own[:1])
                        b.append(own[1:])
                    continue
                same = np.zeros((hi - lo, hi - lo), np.uint8)
                for k in range(sub.shape[1]):
                    same += sub[:, k][:, None] == sub[:, k][None, :]
                linked = same >= least
                if b1[lo] != b2[lo]:
                    linked &= home[lo:hi][:, None] != home[lo:hi][None, :]
                root = shared.roots(linked)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                a.append(own[moved])
                b.append(own[root[moved]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    return dealt.select("node", "b1", "b2", "home", "vertex", "tags").mapInArrow(run, "a long, b long")


def _verified(docs: DataFrame, members: DataFrame, s: Settings, text: str) -> DataFrame:
    """(vertex, links, texts, root) of each vertex with a link in a block: documents and texts linked, smallest linked."""
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    wanted = members.join(sizes, "component").select("rep", "vertex", "component", "copies", "size")
    # wanted grows with the input: a merge join at every size
    found = docs.select(F.col("doc_id").alias("rep"), text).join(wanted.hint("merge"), "rep").select("vertex", "component", "copies", "size", text)

    def shingled(batches):
        for batch in batches:
            for lo, n, words, owner, grams, whose in _sets(batch.column(4), s):
                key = _class_keys(words, owner, n).view(np.int64)
                order = np.lexsort((grams, whose))
                grams, whose = grams[order], whose[order]
                new = np.ones(len(grams), bool)
                new[1:] = (grams[1:] != grams[:-1]) | (whose[1:] != whose[:-1])
                grams, whose = grams[new], whose[new]
                at = np.searchsorted(whose, np.arange(n + 1))
                sets = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * 8).astype(np.int32).tobytes()), pa.py_buffer(grams.tobytes())])
                out = pa.RecordBatch.from_arrays([*(batch.column(k).slice(lo, n) for k in range(4)), sets], names=["vertex", "component", "copies", "size", "grams"])
                yield out.filter(pa.array(key == batch.column(0).slice(lo, n).to_numpy()))

    sets = found.mapInArrow(shingled, "vertex long, component long, copies long, size long, grams binary")
    dealt = shared.dealt_blocks(sets, ["component"], "vertex", "size", s.set_rows)

    def run(batches):
        for batch, cuts in shared.groups(batches, ["component", "b1", "b2"]):
            ids, copies, home, b1, b2 = (batch.column(c).to_numpy() for c in ("vertex", "copies", "home", "b1", "b2"))
            column = batch.column("grams")
            at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) // 8
            data = np.frombuffer(column.buffers()[2] or b"", np.uint64)
            out = [[], [], [], []]
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                rows = lo + np.unique(ids[lo:hi], return_index=True)[1]  # a repeated row counts in copies
                if len(rows) < 2:
                    continue
                sizes = (at[rows + 1] - at[rows]).astype(np.int64)
                shared_n = _intersections(data, at, rows, sizes)
                union = sizes[:, None] + sizes[None, :] - shared_n
                linked = shared_n >= s.threshold * union - 1e-9
                np.fill_diagonal(linked, False)
                if b1[lo] != b2[lo]:
                    linked &= home[rows][:, None] != home[rows][None, :]
                has = np.flatnonzero(linked.any(1))
                if len(has):
                    out[0].append(ids[rows[has]])
                    out[1].append((linked[has] @ copies[rows].astype(float)).astype(np.int64))
                    out[2].append(linked[has].sum(1))
                    out[3].append(ids[rows[shared.roots(linked)[has]]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in out], names=["vertex", "links", "texts", "root"])

    return dealt.select("component", "b1", "b2", "home", "vertex", "copies", "grams").mapInArrow(run, "vertex long, links long, texts long, root long")


def _intersections(data, at, rows, sizes) -> np.ndarray:
    """How many shingles each two rows share: products of their incidence matrices, some thousand shingles at a time."""
    n = len(rows)
    grams = np.concatenate([data[at[r] : at[r + 1]] for r in rows])
    whose = np.repeat(np.arange(n), sizes)
    if n == 2:
        both = len(grams) - len(np.unique(grams))
        return np.array([[sizes[0], both], [both, sizes[1]]])
    order = np.argsort(grams, kind="stable")
    grams, whose = grams[order], whose[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number)
    keep = often[number] > 1
    number, whose = number[keep], whose[keep]
    total = np.zeros((n, n))
    if len(number):
        number = np.unique(number, return_inverse=True)[1]
        step = max(256, (1 << 22) // n)
        for lo in range(0, int(number[-1]) + 1, step):
            a, b = np.searchsorted(number, [lo, lo + step])
            part = np.zeros((n, min(step, int(number[-1]) + 1 - lo)), np.float32)
            part[whose[a:b], number[a:b] - lo] = 1
            total += part @ part.T
    total[np.arange(n), np.arange(n)] = sizes
    return total


def join(docs: DataFrame, s: Settings | None = None, text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, n_texts, kept) of every row of docs.

    n_links counts the other documents linked with this one (same words, or Jaccard similarity of the shingle sets
    at or over the threshold), n_texts the different word sequences among them; class_id is the smallest doc_id reachable
    by links, and kept marks that document. A text of fewer words than a shingle is one shingle; texts without words
    (null, empty) and rows with a null doc_id link with nothing. Repeated rows count as copies.
    """
    s = s or Settings()
    signed = shared.stored(signatures(docs, s, text))
    classes = shared.stored(signed.groupBy("vertex").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("tags").alias("tags"), F.first("nodes").alias("nodes"), F.first("deeper").alias("deeper")))
    close = shared.components(_agreeing(classes, s))
    members = shared.stored(classes.select("vertex", "rep", "copies").join(close, "vertex"))
    found = shared.stored(_verified(docs, members, s, text))
    parts = shared.components(found.select(F.col("vertex").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vertex").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    tied = members.select("vertex", "rep").join(parts.withColumnRenamed("component", "part"), "vertex")
    least = tied.groupBy("part").agg(F.min("rep").alias("class_id"))
    linked = tied.join(least, "part").join(counts, "vertex").select("vertex", "class_id", "links", "texts")
    known = classes.select("vertex", "rep", "copies").join(linked, "vertex", "left").select("vertex", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"))
    rows = signed.select("doc_id", "vertex").join(known, "vertex").select("doc_id", "class_id", "n_links", "n_texts")
    # texts without words and rows without an id have no signature
    bare = docs.select("doc_id").exceptAll(signed.select("doc_id")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_texts"))
    return rows.unionByName(bare).withColumn("kept", F.col("class_id").eqNullSafe(F.col("doc_id")))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Class and number of links of every document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class, that of the smallest doc_id (of its repeated rows, all)."""
    found = join(docs.select("doc_id", "text"))
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
