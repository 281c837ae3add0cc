"""Merkle manifests against a plain version, SQL, and the definition of the layout."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import merkle
from wardlight.llm.queries import QUERIES


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return digest(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(leaves):
    """All levels, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, k):
    """(digest beside, whether it is left) of each level."""
    found = []
    for level in levels[:-1]:
        beside = level[k ^ 1:(k ^ 1) + 1]
        found.append((beside[0] if beside else "", bool(k & 1)))
        k //= 2
    return found


def plain(rows):
    """``rows``: (doc_id, group, leaf, seen)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = plain_tree([r[2] for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        for k, (doc_id, _, leaf, seen) in enumerate(groups[g]):
            path = way(trees[g], k) + way(top, place)
            folded = seen
            for beside, left in path:
                folded = digest(beside, folded) if left else digest(folded, beside)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], digest(*[b for b, _ in path]), folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("levels", range(1, 10))
def test_layout_is_cut_at_half_height(levels):
    def order(root, height):
        if height == 1:
            return [root]
        above = height // 2
        found = order(root, above)
        for k in range(1 << above):
            found += order((root << above) + k, height - above)
        return found

    place = {node: k for k, node in enumerate(order(1, levels))}
    for depth in range(levels):
        nodes = np.arange(1 << depth, 2 << depth)
        assert merkle.addresses(nodes, depth, levels).tolist() == [place[x] for x in nodes.tolist()]


@pytest.mark.parametrize("height", [1, 2, 5, 12])
def test_equals_plain_for_all_heights_and_sizes(spark, height):
    sizes = {None: 1, "": 2, "a": 37, "b": 16, "é": 8, "z": 1}
    rows = [(k * 3 % 41, g, plain_leaf(k, g), plain_leaf(k, g) if k % 5 else "0" * 64) for g, n in sizes.items() for k in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, group string, leaf string, seen string").repartition(5)
    assert Counter(tuple(r) for r in merkle.proofs(merkle.build(frame, height)).collect()) == plain(rows)


def test_one_group_one_leaf_and_none(spark, none):
    frame = spark.createDataFrame([(1, "g", "ab" * 32, "ab" * 32)], "doc_id long, group string, leaf string, seen string")
    row = merkle.proofs(merkle.build(frame)).first()
    assert row.root == row.subroot == row.leaf == row.folded_root and row.verified and row.proof_sha256 == digest()
    empty = merkle.build(frame.where("false"))
    assert empty.root is None and merkle.proofs(empty).collect() == []


def test_odd_rows(odd, none):
    """Null ids and fields, repeated rows, clashing columns."""
    docs = odd.select(*[F.col(c) for c in merkle.FIELDS])
    want = [(r.doc_id, r.lang, plain_leaf(*r), plain_leaf(*r)) for r in docs.collect()]
    rows = odd.select("doc_id", F.col("lang").alias("group"), merkle.leaf_hash(*map(F.col, merkle.FIELDS)).alias("leaf")).withColumn("seen", F.col("leaf"))
    found = merkle.proofs(merkle.build(rows, 3))
    assert Counter(tuple(r) for r in found.collect()) == plain(want) and found.where("NOT verified").count() == 0


def test_registered_query_equals_sql_and_finds_tampering(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES["op13_merkle_manifest"](spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(merkle.ORACLE).fetchall())
    tampered = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None}
    assert tampered and {r.doc_id for r in got.where("NOT verified").collect()} == tampered
