"""Exact inner-product top-k with a ball tree in each shard.

Candidates are dealt to shards of a bounded number of rows, queries to blocks. A
shard's ball tree is searched for a whole block at once: at each node the bound is
centre . query + radius * |query|; a child whose bound is below the query's current
kth score is left out, and each query goes to the child of the larger bound first.
Every query first searches one home shard; the kth score found there is shared with
all other shards as the start of their search, so most of their nodes are cut early.
Results are merged by query; a query gets at most k rows of each shard.

Components are whole numbers, so scores are exact: matrix products in doubles while
all sums stay below 2^53, in 64-bit integers beyond. Vectors that are null, empty,
hold a null or non-finite component, or have no vec_id take no part; vectors are
compared with those of the same size. Rows with the query's own vec_id are not its
candidates. Equal rows each count. Fewer candidates than k give fewer rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 2048, 128
FOUND = "query_id long, vec_id long, score long"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NONE, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class BallTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.leaf, self.nodes = leaf, []
        self.order = np.arange(len(ids))
        self.points = vectors.astype(np.float64)
        if len(ids):
            self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.largest = int(np.abs(vectors).max(initial=0))

    def _build(self, a: int, b: int) -> int:
        rows = self.points[self.order[a:b]]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        k = len(self.nodes)
        self.nodes.append([centre, radius, a, b, -1, -1])
        if b - a > self.leaf:
            axis = int(np.argmax(rows.max(axis=0) - rows.min(axis=0)))
            middle = (b - a) // 2
            part = np.argpartition(rows[:, axis], middle)
            self.order[a:b] = self.order[a:b][part]
            self.nodes[k][4] = self._build(a, a + middle)
            self.nodes[k][5] = self._build(a + middle, b)
        return k


class Search:
    """Top k of a block of queries over one tree."""

    def __init__(self, tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None):
        self.tree, self.query_ids, self.k = tree, query_ids, k
        self.points = queries.astype(np.float64)
        self.norm = np.sqrt((self.points ** 2).sum(axis=1))
        self.scores = np.full((len(query_ids), k), _NONE, np.int64)
        self.found = np.full((len(query_ids), k), _NO_ID, np.int64)
        #: kth score known so far, from elsewhere or from this search
        self.kth = np.full(len(query_ids), _NONE, np.int64) if kth is None else kth.copy()
        most = queries.shape[1] * int(np.abs(queries).max(initial=0)) * tree.largest if len(queries) else 0
        self.exact = self.points if most < 2 ** 53 else queries.astype(np.int64)
        self.table = tree.vectors.astype(np.float64 if most < 2 ** 53 else np.int64)
        if tree.nodes:
            self._visit(0, np.arange(len(query_ids)))

    def _bound(self, node: int, rows: np.ndarray) -> np.ndarray:
        centre, radius = self.tree.nodes[node][:2]
        bound = self.points[rows] @ centre + radius * self.norm[rows]
        return bound + 1e-9 * np.abs(bound) + 1e-6

    def _open(self, node: int, rows: np.ndarray) -> np.ndarray:
        """Rows whose bound is not below their kth score; an equal score may win by its vec_id."""
        return rows[self._bound(node, rows) >= self.kth[rows]]

    def _visit(self, node: int, rows: np.ndarray) -> None:
        rows = self._open(node, rows)
        if not len(rows):
            return
        _, _, a, b, left, right = self.tree.nodes[node]
        if left < 0:
            self._leaf(a, b, rows)
            return
        first = self._bound(left, rows) >= self._bound(right, rows)
        self._visit(left, rows[first])
        self._visit(right, rows[~first])
        self._visit(right, rows[first])
        self._visit(left, rows[~first])

    def _leaf(self, a: int, b: int, rows: np.ndarray) -> None:
        scores = (self.exact[rows] @ self.table[a:b].T).astype(np.int64)
        ids = np.broadcast_to(self.tree.ids[a:b], scores.shape)
        own = ids == self.query_ids[rows, None]
        scores = np.hstack([self.scores[rows], np.where(own, _NONE, scores)])
        ids = np.hstack([self.found[rows], np.where(own, _NO_ID, ids)])
        order = np.lexsort((ids, ~scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(ids, order, 1)
        self.kth[rows] = np.maximum(self.kth[rows], self.scores[rows, -1])

    def table_of_hits(self) -> pa.Table:
        row, rank = np.nonzero(self.found != _NO_ID)
        return pa.table([self.query_ids[row], self.found[row, rank], self.scores[row, rank]], schema=_FOUND)


def whole_numbers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str) -> Column:
    """Whether a vector has components, all of them finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.int64).reshape(-1, size)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _search(k: int):
    def kernel(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return _FOUND.empty_table()
        size = key[0].as_py()
        tree = BallTree(_ids(shard, "vec_id"), _matrix(shard.column("vector"), size))
        kth = _ids(block, "kth") if "kth" in block.schema.names else None
        return Search(tree, _ids(block, "query_id"), _matrix(block.column("vector"), size), k, kth).table_of_hits()

    return kernel


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``vectors`` has vec_id and vector (array of long), ``queries`` query_id and vector."""
    n_shards = max(1, -(-vectors.count() // SHARD_ROWS))
    n_blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    shards = vectors.select(F.size("vector").alias("size"), deal("vec_id", n_shards, 1).alias("shard"), "vec_id", "vector")
    asked = stored(queries.select(
        F.size("vector").alias("size"), deal("query_id", n_shards, 2).alias("home"), deal("query_id", n_blocks, 3).alias("block"), "query_id", "vector"))
    home = asked.select("size", F.col("home").alias("shard"), "query_id", "vector")
    first = stored(shards.groupBy("size", "shard").cogroup(home.groupBy("size", "shard")).applyInArrow(_search(k), FOUND))
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(int(_NONE))).alias("kth"))
    others = asked.join(least, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(int(_NONE))))
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).where("shard <> home").select("size", "shard", "block", "query_id", "vector", "kth")
    cells = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    rest = cells.groupBy("size", "shard", "block").cogroup(others.groupBy("size", "shard", "block")).applyInArrow(_search(k), FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
