"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas layout.

A row is a leaf, the hash of its fields. The leaves of a group stand in order; every
two neighbours become the hash of both, a last single one the hash of itself, until
one node is left, the group's subroot. The subroots, ordered by group, are leaves of
the top tree, whose last node is the root.

Leaves get their places by a range sort and the counts of earlier writers, so one group
may hold most rows. Aligned subtrees of ``2 ** height`` leaves are built by a task each
and written as one row: their digests in van Emde Boas order, cut recursively at half
the height, so that a path from leaf to root touches few pages whatever their size. An
address follows from three small tables by depth, in construction and in retrieval
alike. The roots of these subtrees are the leaves of the next round, until one is left.
Proofs go back down by the same rounds: each subtree adds its part below the path of
its root, and only the leaves' own subtree meets the rows.

A null field is hashed as ``-``. A null group comes first, a null doc_id comes first in
its group; rows with equal doc_id stand by leaf hash (equal rows are equal leaves, in
any order). A group of one leaf has that leaf as subroot, a single group its subroot as
root. Empty tables give no rows. Only the fields are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch, ship, stored
from .columns import lookup

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels above the leaves of a stored subtree: 4096 leaves, 256 KB.
HEIGHT = 12
_SUBTREES = "grp string, block long, n long, nodes binary"
_PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(*fields: Column) -> Column:
    """Hash of fields, each as ``-`` or its number of bytes, ``:`` and itself."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


# --- addresses -------------------------------------------------------------------------------------------------


@lru_cache(maxsize=64)
def _cuts(levels: int) -> tuple[tuple[int, int, int], ...]:
    """For each depth but the first: depth of the root of the tree it is cut from, nodes of the part above, nodes of a part below."""
    found = {}

    def cut(first: int, end: int) -> None:
        if end - first < 2:
            return
        middle = first + (end - first) // 2
        found[middle] = (first, (1 << (middle - first)) - 1, (1 << (end - middle)) - 1)
        cut(first, middle)
        cut(middle, end)

    cut(0, levels)
    return ((0, 0, 0), *[found[d] for d in range(1, levels)])


def addresses(nodes: np.ndarray, depth: int, levels: int) -> np.ndarray:
    """Places in van Emde Boas order of nodes of one depth, given by heap number (root 1, children 2i and 2i + 1)."""
    if depth == 0:
        return np.zeros(len(nodes), np.int64)
    root, above, below = _cuts(levels)[depth]
    return addresses(nodes >> (depth - root), root, levels) + above + (nodes & above) * below


def _join(left: bytes, right: bytes = b"") -> bytes:
    return sha256(left.hex().encode() + right.hex().encode()).digest()


class Subtree:
    """A stored subtree over ``count`` leaves that is ``height`` levels high."""

    def __init__(self, nodes: np.ndarray, count: int, height: int):
        self.nodes, self.count, self.height = nodes, count, height

    @classmethod
    def over(cls, leaves: list[bytes], height: int) -> "Subtree":
        tree = cls(np.zeros(((2 << height) - 1, 32), np.uint8), len(leaves), height)
        tree._put(0, leaves)
        for up in range(1, height + 1):
            leaves = [_join(*leaves[k:k + 2]) for k in range(0, len(leaves), 2)]
            tree._put(up, leaves)
        return tree

    def _at(self, up: int, places: np.ndarray) -> np.ndarray:
        """Addresses of nodes ``up`` levels above the leaves, by their place in that level."""
        depth = self.height - up
        return addresses((1 << depth) + places, depth, self.height + 1)

    def _put(self, up: int, digests: list[bytes]) -> None:
        self.nodes[self._at(up, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def siblings(self, places: np.ndarray) -> list[list[str | None]]:
        """For each level from the leaves up: the digest beside the path of each leaf, None where there is none."""
        found = []
        for up in range(self.height):
            beside = (places >> up) ^ 1
            there = beside < -(-self.count // (1 << up))
            digests = self.nodes[self._at(up, np.where(there, beside, 0))].tobytes()
            found.append([digests[32 * k:32 * k + 32].hex() if x else None for k, x in enumerate(there.tolist())])
        return found

    def paths(self, places: np.ndarray) -> tuple[list[str], list[str]]:
        """Proof (digests beside the path, in a row) and sides (a letter a level: L, R, or - for none) of each leaf."""
        levels = list(zip(*self.siblings(places), strict=True)) or [()] * len(places)
        proofs = ["".join(filter(None, x)) for x in levels]
        sides = ["".join("-" if d is None else "RL"[p >> up & 1] for up, d in enumerate(x)) for p, x in zip(places.tolist(), levels, strict=True)]
        return proofs, sides


def fold(leaf: str, proof: str, sides: str) -> str:
    """The root that a leaf and the digests beside its path give."""
    at = 0
    for side in sides:
        beside = "" if side == "-" else proof[at:at + 64]
        at += len(beside)
        leaf = sha256((beside + leaf if side == "L" else leaf + beside).encode()).hexdigest()
    return leaf


# --- rounds ----------------------------------------------------------------------------------------------------


def _size(n: int, block: int, height: int) -> tuple[int, int]:
    """Leaves and levels of a block of a round with n nodes."""
    return min(1 << height, n - (block << height)), min(height, (n - 1).bit_length())


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` (grp and more, a written table) with pos, their place within grp, and n, the rows of grp.

    ``order`` with grp must tell rows apart, so that a range never grows beyond its share.
    """
    schema = rows.withColumns({"writer": F.lit(0), "place": F.lit(0).cast("long")}).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp")
            codes = grp.dictionary_encode().indices.to_numpy()
            starts = np.append(0, np.flatnonzero(codes[1:] != codes[:-1]) + 1)
            place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
            if grp[0].as_py() == last:
                place[:starts[1] if len(starts) > 1 else len(codes)] += seen
            last, seen = grp[-1].as_py(), int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), task, np.int32)), pa.array(place)], names=schema.names)

    ranged = stored(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).mapInArrow(kernel, schema))
    counts = ranged.groupBy("grp", "writer").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("grp")
    earlier = whole.orderBy("writer").rowsBetween(Window.unboundedPreceding, -1)
    table = stored(counts.select("grp", "writer", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n")))
    found = lookup(ranged, table, ["grp", "writer"], "inner", F.col("place"))
    return found.withColumn("pos", F.col("place") + F.col("before")).drop("place", "before", "writer")


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Subtrees of each round over ``nodes`` (grp, pos, n, node)."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, block = table.column("n")[0].as_py(), key[1].as_py()
        tree = Subtree.over([bytes.fromhex(x) for x in table.column("node").to_pylist()], _size(n, block, height)[1])
        return pa.table({"grp": [key[0].as_py()], "block": [block], "n": [n], "nodes": [tree.nodes.tobytes()]},
                        schema=pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("nodes", pa.binary())]))

    rounds = []
    while True:
        dealt = nodes.select("grp", F.expr(f"shiftright(pos, {height})").alias("block"), "pos", "n", "node")
        rounds.append(stored(dealt.groupBy("grp", "block").applyInArrow(build, _SUBTREES), keep=True))
        most = rounds[-1].agg(F.max("n")).first()[0]
        if most is None or most <= 1 << height:
            return rounds
        roots = rounds[-1].where(F.col("n") > 1 << height)
        nodes = roots.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).cast("long").alias("n"), _root().alias("node"))


def _root() -> Column:
    return F.lower(F.hex(F.substring("nodes", 1, 32)))


def _finished(rounds: list[DataFrame], height: int) -> DataFrame:
    """grp and the root of its tree."""
    parts = [r.where(F.col("n") <= 1 << height).select("grp", _root().alias("node")) for r in rounds]
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    return found


def _below(subtrees: DataFrame, height: int) -> DataFrame:
    """grp, place, proof and sides of every leaf of ``subtrees`` that have those of their own roots."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree, count = _stored_tree(row, height)
                own, sides = tree.paths(np.arange(count))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["grp"]] * count, pa.string()), pa.array((row["block"] << height) + np.arange(count)),
                     pa.array([p + row["proof"] for p in own], pa.string()), pa.array([s + row["sides"] for s in sides], pa.string())], names=["grp", "place", "proof", "sides"])

    return subtrees.mapInArrow(kernel, "grp string, place long, proof string, sides string")


def _stored_tree(row: dict, height: int) -> tuple[Subtree, int]:
    count, levels = _size(row["n"], row["block"], height)
    return Subtree(np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32), count, levels), count


def _descended(rounds: list[DataFrame], ends: DataFrame, height: int) -> DataFrame:
    """The subtrees of the first round with proof and sides of their roots. ``ends`` has grp, and proof and sides of its tree's root."""
    found = None
    for r in reversed(rounds):
        here = r.where(F.col("n") <= 1 << height).join(ends, "grp")
        if found is not None:
            here = here.unionByName(r.join(found, ["grp", "block"]))
        found = stored(_below(here, height).withColumnRenamed("place", "block")) if r is not rounds[0] else here
    return found


@dataclass
class Manifest:
    """The written manifest. ``leaves``: doc_id, grp, pos, n, leaf, seen. ``rounds`` and ``top``: grp, block, n, nodes. ``groups``: grp, pos, subroot."""

    leaves: DataFrame
    rounds: list[DataFrame]
    groups: DataFrame
    top: list[DataFrame]
    root: str | None
    height: int


def _key(group: Column) -> Column:
    """A group's name as a key that is never null and keeps the order, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def build(rows: DataFrame, height: int = HEIGHT) -> Manifest:
    """The manifest of ``rows``: doc_id, group, leaf (hex digest) and seen (the digest that is found now, which ``proofs`` judges)."""
    ship(rows.sparkSession)
    with scratch(rows.sparkSession):
        # a number of the written row tells apart what is equal in all else
        leaves = stored(rows.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("group")).alias("grp"), "leaf", "seen", F.monotonically_increasing_id().alias("row")))
        leaves = stored(_numbered(leaves, ["doc_id", "leaf", "row"]).drop("row"), keep=True)
        rounds = _rounds(leaves.select("grp", "pos", "n", F.col("leaf").alias("node")), height)
        subroots = stored(_finished(rounds, height).select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("node")))
        groups = stored(_numbered(subroots, ["name"]), keep=True)
        top = _rounds(groups.select("grp", "pos", "n", "node"), height)
        root = _finished(top, height).first()
    return Manifest(leaves, rounds, groups.select(F.col("name").alias("grp"), "pos", F.col("node").alias("subroot")), top, root and root.node, height)


def proofs(manifest: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from ``seen`` and the digests beside the path) and verified, of each leaf."""
    height, root = manifest.height, manifest.root
    spark = manifest.leaves.sparkSession
    with scratch(spark):
        ends = spark.createDataFrame([("", "", "")], "grp string, proof string, sides string")
        places = _below(_descended(manifest.top, ends, height), height).withColumnRenamed("place", "pos").drop("grp")
        groups = stored(manifest.groups.join(places, "pos").drop("pos"))
        subtrees = _descended(manifest.rounds, groups.drop("subroot"), height)
        # a group may hold most subtrees
        subtrees = stored(lookup(subtrees, groups.select("grp", "subroot"), ["grp"], "inner", F.col("block")), keep=True)

    def prove(key: tuple, leaves: pa.Table, trees: pa.Table) -> pa.Table:
        row = trees.to_pylist()[0]
        tree, _ = _stored_tree(row, height)
        own, sides = tree.paths(leaves.column("pos").to_numpy() - (row["block"] << height))
        whole = [p + row["proof"] for p in own]
        folded = [fold(x, p, s + row["sides"]) for x, p, s in zip(leaves.column("seen").to_pylist(), whole, sides, strict=True)]
        n = len(whole)
        return pa.table({
            "doc_id": leaves.column("doc_id"), "leaf": leaves.column("leaf"), "subroot": pa.array([row["subroot"]] * n, pa.string()), "root": pa.array([root] * n, pa.string()),
            "proof_sha256": pa.array([sha256(p.encode()).hexdigest() for p in whole], pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_())})

    leaves = manifest.leaves.withColumn("block", F.expr(f"shiftright(pos, {height})"))
    return leaves.groupBy("grp", "block").cogroup(subtrees.groupBy("grp", "block")).applyInArrow(prove, _PROVEN)


ORACLE = r"""
WITH RECURSIVE f AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, n_chars,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS crc FROM documents),
l AS (SELECT doc_id, grp, sha256(head || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || tail) AS leaf,
  sha256(head || coalesce(octet_length(encode(CAST(n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR))) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS seen FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM l),
t AS (SELECT grp, 0 AS up, pos, leaf AS node, n FROM p UNION ALL
  SELECT grp, up + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(min_by(node, pos) || max_by(node, pos)) ELSE sha256(min(node)) END, (n + 1) // 2 FROM t WHERE n > 1 GROUP BY grp, up, pos // 2, n),
s AS (SELECT grp, up AS levels, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS up, pos, subroot AS node, n FROM s UNION ALL
  SELECT up + 1, pos // 2, CASE WHEN count(*) = 2 THEN sha256(min_by(node, pos) || max_by(node, pos)) ELSE sha256(min(node)) END, (n + 1) // 2 FROM u WHERE n > 1 GROUP BY up, pos // 2, n),
root AS (SELECT node AS root FROM u WHERE n = 1),
low AS (SELECT p.grp, p.pos, a.up, coalesce(b.node, '') AS beside, (p.pos >> a.up) & 1 AS side FROM p JOIN (SELECT DISTINCT grp, up FROM t WHERE n > 1) a USING (grp)
  LEFT JOIN t b ON b.grp = p.grp AND b.up = a.up AND b.pos = xor(p.pos >> a.up, 1)),
high AS (SELECT s.grp, p.pos, s.levels + a.up AS up, coalesce(b.node, '') AS beside, (s.pos >> a.up) & 1 AS side FROM p JOIN s USING (grp), (SELECT DISTINCT up FROM u WHERE n > 1) a
  LEFT JOIN u b ON b.up = a.up AND b.pos = xor(s.pos >> a.up, 1)),
way AS (SELECT grp, pos, list(beside ORDER BY up) AS besides, list(CASE side WHEN 1 THEN 'L' ELSE 'R' END || beside ORDER BY up) AS steps FROM (SELECT * FROM low UNION ALL SELECT * FROM high) GROUP BY grp, pos),
done AS (SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(besides, ''), '')) AS proof_sha256,
  list_reduce(list_prepend(seen, coalesce(steps, [])), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root
  FROM p JOIN s USING (grp), root LEFT JOIN way ON way.grp = p.grp AND way.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""
