"""op13: a Merkle manifest of a dataset: a postorder append log of nodes, and proofs read from it by closed-form positions.

A node's digest is the lowercase hex SHA-256 of its children's digests as text. Leaves of a group stand in order; while more than
one node remains, each two neighbours become one, a lone last one too. Nodes are logged as they are completed, children before
parents. Before leaf j stand 2 j - popcount(j) nodes, as each whole subtree of 2**h leaves that ended before it has 2**(h+1) - 1
nodes; a node of height h follows its last leaf by h places. So a sibling's place in the log follows from its height and number.

Groups are built by aligned blocks of 2**12 leaves, each a task's small part: a block's log is the same run of places wherever it
stands, and starts at 2 j - popcount(j) of its first leaf. Roots of blocks are the leaves of the next round, which builds the upper
part of each group in the same way; a round divides the rows by 4,096. Then the groups' roots, in the order of their names, form
one more tree. A group may hold any share of the rows: positions come from a range partitioning over all rows, and a block never
holds more than 4,096. Proofs come from the top down: a leaf's path is that inside its block, then that of its block's root, then
that of its group's root, each joined once a block.

Rows: leaves ascend by doc_id, null first, rows of one doc_id by their digests (equal rows have equal digests, and each has its
own proof). Groups ascend by the bytes of lang, null first. Null values are `-`, empty texts `0:`. Extra columns play no part. An
empty table gives no rows. A tampered leaf is that of n_chars + 1 (beyond a long it stays as it is) and the original elsewhere.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Height of a block: up to 2**HEIGHT leaves.
HEIGHT = 12
_DIGEST = 64


def part_of(column: str) -> Column:
    """A value's share of a leaf: `-` if null, else the number of its UTF-8 bytes, a colon and the value."""
    text = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[str]) -> Column:
    return F.sha2(F.concat(*map(part_of, columns)), 256)


# -------------------------------------------------------------- closed forms


def before_leaf(j: int) -> int:
    """Nodes completed before leaf j."""
    return 2 * j - j.bit_count()


def place(height: int, number: int, leaves: int) -> int:
    """The place in the log of the number-th node of a height, in a tree of so many leaves."""
    return before_leaf(min((number + 1) << height, leaves) - 1) + height


def tree_height(leaves: int) -> int:
    return (leaves - 1).bit_length()


def build(digests: list[bytes], height: int) -> list[bytes]:
    """The postorder log of a tree over the leaves, up to a height: each node as it is completed.

    A stack holds the open nodes of each height; the end closes them from below, a lone node too.
    """
    log, open_ = [], [None] * (height + 1)
    for digest in digests:
        h = 0
        log.append(digest)
        while h < height and open_[h] is not None:
            digest, open_[h], h = sha256(open_[h] + digest).hexdigest().encode(), None, h + 1
            log.append(digest)
        open_[h] = digest
    if open_[height] is not None:
        return log
    rest = None  # the completed right edge below height h
    for h in range(height):
        pair = [x for x in (open_[h], rest) if x is not None]
        if pair:
            rest = sha256(b"".join(pair)).hexdigest().encode()
            log.append(rest)
    return log


def path(log: bytes, leaf: int, leaves: int, height: int) -> bytes:
    """The siblings of a leaf's way up to a height: each a mark (l, r: where it stands; -: none) and its digest, if any."""
    out = []
    for h in range(height):
        number = leaf >> h
        other = number ^ 1
        if other << h >= leaves:
            out.append(b"-")
            continue
        at = place(h, other, leaves) * _DIGEST
        out.append((b"l" if other < number else b"r") + log[at : at + _DIGEST])
    return b"".join(out)


def fold(digest: bytes, way: bytes) -> bytes:
    """The root that a leaf and the siblings of its way give."""
    at = 0
    while at < len(way):
        mark, at = way[at : at + 1], at + 1
        sibling = b"" if mark == b"-" else way[at : at + _DIGEST]
        at += len(sibling)
        digest = sha256(sibling + digest if mark == b"l" else digest + sibling).hexdigest().encode()
    return digest


def siblings(way: bytes) -> bytes:
    """The digests of a way, in order."""
    out, at = [], 0
    while at < len(way):
        mark, at = way[at : at + 1], at + 1
        if mark != b"-":
            out.append(way[at : at + _DIGEST])
            at += _DIGEST
    return b"".join(out)


# --------------------------------------------------------------------- rounds


def numbered(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows in order, stored, with their run and number; and the runs: (group, run, first, past, leaves).

    Rows are range-partitioned by group and order and sorted; a run is what a partition holds of a group. A row's place in its
    group is its number less its run's first one, and past, the group's rows in runs before. The window sees a row a run.
    """
    ordered = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    kept = shared.stored(ordered.withColumn("number", F.monotonically_increasing_id()).withColumn("run", F.shiftright("number", 33)))
    runs = kept.groupBy(group, "run").agg(F.min("number").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy(group)
    past = F.sum("n").over(own.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    return kept, runs.select(group, "run", "first", F.coalesce(past, F.lit(0).cast("long")).alias("past"), F.sum("n").over(own).alias("leaves"))


AT = "number - first + past"


def _building():
    """Blocks: rows of (group, block) sorted by place become one row with its packed leaves, its log and its root."""

    def run(batches):
        for t, bounds in shared.groups(batches, ["gid", "block"]):
            gid, block = t.column("gid").to_numpy(), t.column("block").to_numpy()
            leaves = t.column("leaves").to_numpy()
            digests = t.column("digest").to_pylist()
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                height = min(HEIGHT, tree_height(int(leaves[lo])))
                log = build([d.encode() for d in digests[lo:hi]], height)
                yield pa.RecordBatch.from_arrays([pa.array(gid[lo : lo + 1]), pa.array(block[lo : lo + 1]), pa.array([int(hi - lo)], pa.int64()), pa.array([height], pa.int64()), pa.array([b"".join(log)], pa.binary()), pa.array([log[-1].decode()])], names=["gid", "block", "held", "height", "log", "digest"])

    return run


def logged(nodes: DataFrame) -> DataFrame:
    """The logs of blocks of nodes (gid, at, leaves, digest), a row a block: (gid, block, held, height, log, digest of its root)."""
    dealt = nodes.select("gid", F.shiftright("at", HEIGHT).alias("block"), "at", "leaves", "digest").repartition("gid", "block").sortWithinPartitions("gid", "block", "at").drop("at")
    return shared.stored(dealt.mapInArrow(_building(), "gid long, block long, held long, height long, log binary, digest string"))


def _ways(batches):
    """The way of each node of packed blocks: (gid, at, way), the block's own way after the node's."""
    for b in batches:
        for row in b.to_pylist():
            found = [path(row["log"], i, row["held"], row["height"]) + (row["above"] or b"") for i in range(row["held"])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(row["held"], row["gid"])), pa.array((row["block"] << HEIGHT) + np.arange(row["held"])), pa.array(found, pa.binary())], names=["gid", "at", "way"])


def forest(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Build the tree of each group of nodes (gid, at, leaves, digest).

    Gives the logs of the lowest blocks, each with `above`: the way of its root to the group's, and (gid, digest) of the roots.
    """
    rounds, now = [], nodes
    while True:
        blocks = logged(now)
        rounds.append(blocks)
        per = blocks.groupBy("gid").agg(F.count("*").alias("leaves"))
        more = per.agg(F.max("leaves")).first()[0] or 0
        if more <= 1:
            break
        now = blocks.select("gid", F.col("block").alias("at"), "digest").join(per.where("leaves > 1"), "gid")
    roots = None
    for blocks in rounds:  # a group's root is the only block of its last round
        single = blocks.join(blocks.groupBy("gid").agg(F.count("*").alias("n")).where("n = 1"), "gid").select("gid", "digest")
        roots = single if roots is None else roots.unionByName(single)
    above = None
    for blocks in reversed(rounds):
        if above is None:
            full = blocks.withColumn("above", F.lit(None).cast("binary"))
        else:
            full = blocks.join(above, ["gid", "block"], "left")
        above = None
        if blocks is not rounds[0]:
            above = shared.stored(full.mapInArrow(_ways, "gid long, at long, way binary")).select("gid", F.col("at").alias("block"), F.col("way").alias("above"))
    return full, roots


def _proving(batches):
    """Proofs of the leaves of packed blocks; ids and tampered leaves come packed in the leaves' order."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for b in batches:
        for row in b.to_pylist():
            out: list[tuple] = []
            log, upper = row["log"], (row["above"] or b"") + (row["last"] or b"")
            rest = siblings(upper)
            for i, x in enumerate(row["rows"]):
                own = path(log, i, row["held"], row["height"])
                proof = sha256(siblings(own) + rest).hexdigest()
                folded = fold(fold((x["tampered"] or x["digest"]).encode(), own), upper).decode()
                out.append((x["doc_id"], x["digest"], row["subroot"], row["root"], proof, folded, folded == row["root"]))
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def manifest(docs: DataFrame, columns: list[str], id_col: str, group: str, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row; `tampered` is the altered leaf, null where none."""
    leaves = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group).cast("string").alias("grp"), leaf_of(columns).alias("digest"), tampered.alias("tampered"))
    kept, runs = numbered(shared.stored(leaves), "grp", ["doc_id", "digest"])
    # groups, few or many, are numbered in the order of their names; they are the leaves of the last tree
    names, of = numbered(runs.select("grp").distinct().withColumn("one", F.lit(0)), "one", ["grp"])
    names = names.join(of, ["one", "run"]).select(F.col("grp").alias("name"), F.expr(AT).alias("gid"), F.col("leaves").alias("groups"))
    runs = runs.join(names, F.col("grp").eqNullSafe(F.col("name"))).withColumnsRenamed({"grp": "grp_of", "run": "run_of"})
    met = kept.join(shared.stored(runs), F.col("grp").eqNullSafe(F.col("grp_of")) & (F.col("run") == F.col("run_of")))
    rows = met.select("gid", "groups", F.expr(AT).alias("at"), "leaves", "doc_id", "digest", "tampered")
    rows = shared.stored(rows)
    blocks, subroots = forest(rows)
    subroots = shared.stored(subroots.withColumnsRenamed({"digest": "subroot"}))
    n_groups = rows.agg(F.max("groups")).first()[0] or 0
    top = subroots.select(F.lit(0).cast("long").alias("gid"), F.col("gid").alias("at"), F.lit(n_groups).cast("long").alias("leaves"), F.col("subroot").alias("digest"))
    last, root = forest(top)
    ways = last.mapInArrow(_ways, "gid long, at long, way binary").select(F.col("at").alias("gid"), F.col("way").alias("last"))
    packed = rows.groupBy("gid", F.shiftright("at", HEIGHT).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "doc_id", "digest", "tampered"))).alias("rows"))  # at most 4,096
    full = packed.join(blocks, ["gid", "block"]).join(subroots, "gid").join(ways, "gid").withColumn("root", F.lit(root.select("digest").first()[0] if n_groups else None).cast("string"))
    return full.mapInArrow(_proving, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; where 7 divides the CRC-32 of its id the leaf folded is that of n_chars + 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    more = F.try_add(F.col("n_chars").cast("long"), F.lit(1))
    text = more.cast("string")
    changed = F.concat(*map(part_of, columns[:3]), F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), part_of("text"))
    return manifest(docs, columns, "doc_id", "lang", F.when(hit, F.sha2(changed, 256)))

