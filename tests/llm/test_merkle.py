"""Merkle manifest: logs and closed-form places against plain levels, proofs, odd rows, groups over several rounds."""

import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest

from tidepanel.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, at long, leaf string"


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(tree, i):
    """The siblings of leaf i, and which side."""
    out = []
    for level in tree[:-1]:
        other = i ^ 1
        out.append((level[other] if other < len(level) else "", other < i))
        i //= 2
    return out


def climbed(leaf, ways):
    for sibling, left in ways:
        leaf = h(sibling, leaf) if left else h(leaf, sibling)
    return leaf


@pytest.mark.parametrize("n", [*range(1, 36), 63, 64, 65, 127, 1000])
def test_log_and_places(n):
    nodes = [h(str(i)) for i in range(n)]
    tree = levels(nodes)
    height = merkle.tree_height(n)
    log = [x.decode() for x in merkle.build([x.encode() for x in nodes], height)]
    assert len(tree) == height + 1 and len(log) == sum(map(len, tree)) and log[-1] == tree[-1][0]
    for k, level in enumerate(tree):
        for i, digest in enumerate(level):
            assert log[merkle.place(k, i, n)] == digest
    packed = "".join(log).encode()
    for i in {0, n // 2, n - 1}:
        found = merkle.path(packed, i, n, height)
        assert merkle.siblings(found).decode() == "".join(s for s, _ in way(tree, i)) and merkle.fold(nodes[i].encode(), found).decode() == tree[-1][0]
        assert merkle.fold(h("other").encode(), found).decode() == climbed(h("other"), way(tree, i)) != tree[-1][0]


def plain(rows):
    def leaf(r, more=0):
        n = None if r[3] is None else r[3] + more
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], n, r[4])))

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in groups[g]])
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            ways = way(trees[g], i) + way(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = climbed(leaf(r, 1) if hit else leaf(r), ways)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*(s for s, _ in ways)), folded, folded == top[-1][0]))
    return out


def given(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return list(map(tuple, merkle.op13_merkle_manifest(spark, str(tmp_path)).collect()))


def test_odd_rows(spark, tmp_path):
    rows = [(i, f"s{i % 3}", ("en", "é", "z", None, "")[i % 5] if i % 9 else "en", i, f"text {i}", 1, "x") for i in range(-20, 180)]
    rows += [(None, None, None, None, None, None, None), (None, "s", "en", 1, "", 1, "x"), (5, "s", "en", 3, "again", 1, "x"), (5, "s", "en", 3, "again", 1, "x"), (500, "s", "alone", 2_000_000_000, "語" * 50_000, 1, "x"), (7, "s", "en", None, "t", 1, "x")]
    got = given(spark, rows, tmp_path)
    assert Counter(got) == Counter(plain([r[:5] for r in rows]))
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_several_rounds_and_many_groups(spark, tmp_path):
    rows = [(i, "s", "hot" if i % 3 else f"g{i % 5000:05d}", i % 50, f"t{i}", None, None) for i in range(15_000)]
    assert Counter(given(spark, rows, tmp_path)) == Counter(plain([r[:5] for r in rows]))


def test_empty(spark, tmp_path):
    assert given(spark, [], tmp_path) == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_merkle_manifest"])
def test_equals_sql(spark, name):
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet'")
    expected = con.sql(queries.ORACLE[name])
    rows = queries.QUERIES[name](spark, where).select(*expected.columns).collect()
    assert rows and Counter(map(tuple, rows)) == Counter(expected.fetchall())
