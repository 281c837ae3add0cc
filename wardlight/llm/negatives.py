"""Hard negatives by a secondary sort.

An anchor's positives are its best rows of the same label. A hard negative of a
positive is a row of another label whose score lies in a window below the positive's.

1. Rows are dealt to shards and anchors to blocks of a bounded number of components; a
   shard meets every block. A first pass over these cells gives each anchor's best rows
   of its own label.
2. With these scores known, a second pass leaves only pairs that can still be among the
   first of some window: ``negatives`` a window and cell, so nothing grows with a label.
3. Positives and these pairs are packed into keys of 25 bytes that sort by anchor,
   descending score, positives before negatives, and id. Keys are dealt by anchor and
   sorted within partitions (the DataFrame form of repartitionAndSortWithinPartitions).
   A streaming iterator opens a window for each positive that comes by, and gives the
   negatives that follow to the open windows; it holds the open windows and nothing else.

Components are whole numbers, so scores are exact: products in doubles while all sums
stay below 2^53, in 64-bit integers beyond. Rows with a null vec_id or label, or a
vector that is null, empty, or holds a null or non-finite component take no part;
vectors meet those of their own size. A row with the anchor's vec_id is neither its positive nor its
negative. Rows that repeat a vec_id are rows of their own, as anchors, positives and
negatives. Ties of score go to the smaller vec_id. Fewer rows than asked for give
fewer. An empty table gives no rows. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import top_k
from ..session import scratch, ship, stored
from .columns import lookup

#: Components of a shard or block, and scores that a task holds at once.
COMPONENTS, SCORES = 1 << 19, 1 << 21
_NONE = np.iinfo(np.int64).min
_PAIRS = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_PAIR_ROWS = "anchor long, anchor_id long, vec_id long, score long"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_POSITIVE, _NEGATIVE = 0, 1


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest score from ``low`` to ``high`` per cent of a positive's."""
    return -(-low * positive // 100), high * positive // 100


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    return np.asarray(flat.flatten(), np.int64).reshape(table.num_rows, -1)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first k scores of each row, ties to the smaller id; the lowest number stands for none."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k]
        row, col = np.nonzero((scores >= edge[:, None]) & (scores != _NONE))
    else:
        row, col = np.nonzero(scores != _NONE)
    order = np.lexsort((ids[col], ~scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], col[keep]


def _tiles(anchors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Exact scores of all anchors and rows, some anchors at a time."""
    most = anchors.shape[1] * int(np.abs(anchors).max(initial=0)) * int(np.abs(rows).max(initial=0))
    kind = np.float64 if most < 2 ** 53 else np.int64
    left, right = anchors.astype(kind), rows.astype(kind).T
    step = max(1, SCORES // max(1, len(rows)))
    for k in range(0, len(anchors), step):
        yield slice(k, k + step), (left[k:k + step] @ right).astype(np.int64)


def _cell(find):
    """Kernel of a cell: ``find`` gives row and column of the chosen pairs of a tile of anchors and all rows of the shard."""

    def kernel(key: tuple, shard: pa.Table, block: pa.Table) -> pa.Table:
        if not shard.num_rows or not block.num_rows:
            return _PAIRS.empty_table()
        ids, anchor_ids, anchor = (t.column(c).to_numpy() for t, c in ((shard, "vec_id"), (block, "vec_id"), (block, "anchor")))
        parts = []
        for tile, scores in _tiles(_matrix(block), _matrix(shard)):
            scores[anchor_ids[tile, None] == ids] = _NONE
            row, col = find(scores, block.slice(tile.start, len(scores)), shard)
            at = row + tile.start
            parts.append(pa.table([anchor[at], anchor_ids[at], ids[col], scores[row, col]], schema=_PAIRS))
        return pa.concat_tables(parts)

    return kernel


def _same_label(block: pa.Table, shard: pa.Table) -> np.ndarray:
    return block.column("label").to_numpy()[:, None] == shard.column("label").to_numpy()


def _positives(k: int):
    def find(scores: np.ndarray, block: pa.Table, shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return _first(np.where(_same_label(block, shard), scores, _NONE), shard.column("vec_id").to_numpy(), k)

    return _cell(find)


def _candidates(k: int, low: int, high: int):
    """Pairs that are among the first k of their cell in the window of a positive (``positives``: its scores, a list an anchor)."""

    def find(scores: np.ndarray, block: pa.Table, shard: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, lists = shard.column("vec_id").to_numpy(), block.column("positives").to_pylist()
        other = np.where(_same_label(block, shard), _NONE, scores)
        found = [np.empty(0, np.int64)]
        for j in range(max(map(len, lists), default=0)):
            some = np.array([i for i, x in enumerate(lists) if len(x) > j])
            least, most = np.array([window(lists[i][j], low, high) for i in some]).T
            inside = other[some]
            inside[(inside < least[:, None]) | (inside > most[:, None])] = _NONE
            row, col = _first(inside, ids, k)
            found.append(some[row] * len(ids) + col)
        pairs = np.unique(np.concatenate(found))
        return pairs // len(ids), pairs % len(ids)

    return _cell(find)


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, vec_id: np.ndarray) -> pa.Array:
    """Keys whose byte order is anchor, descending score, kind, id."""
    keys = np.empty(len(anchor), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    flip = np.uint64(1 << 63)
    keys["anchor"], keys["score"] = anchor.view(np.uint64) ^ flip, (~score).view(np.uint64) ^ flip
    keys["kind"], keys["id"] = kind, vec_id.view(np.uint64) ^ flip
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(25), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(keys: pa.Array) -> tuple[list[int], ...]:
    """Anchor, score, kind and id of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), [("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
    signed = lambda c: (raw[c].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return signed("anchor").tolist(), (~signed("score")).tolist(), raw["kind"].tolist(), signed("id").tolist()


def _packed(pairs: DataFrame, kind: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, _, vec_id, score = (c.to_numpy() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pack(anchor, score, kind, vec_id)], names=["anchor", "anchor_id", "key"])

    return pairs.select("anchor", "anchor_id", "vec_id", "score").mapInArrow(kernel, "anchor long, anchor_id long, key binary")


def _emit(negatives: int, low: int, high: int):
    """Streaming iterator over keys in order."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []  # open windows: positive, its score, least, greatest, number given
        for batch in batches:
            out = []
            anchor_ids = batch.column(1).to_pylist()
            for anchor_id, anchor, score, kind, vec_id in zip(anchor_ids, *unpack(batch.column(2)), strict=True):
                if anchor != now:
                    now, windows = anchor, []
                if kind == _POSITIVE:
                    windows.append([vec_id, score, *window(score, low, high), 0])
                    continue
                shut = False
                for w in windows:
                    if w[2] <= score <= w[3]:
                        w[4] += 1
                        out.append((anchor_id, w[0], w[4], vec_id, w[1], score))
                    shut = shut or score < w[2] or w[4] == negatives
                if shut:
                    windows = [w for w in windows if score >= w[2] and w[4] < negatives]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)],
                                             names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return kernel


def _dealt(rows: DataFrame, number: str, parts: str) -> Column:
    """The part of a row, out of the number of parts that its vector size has."""
    return F.pmod(F.xxhash64(number), F.col(parts)).cast("int")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, label and vector (array of long). For each of an anchor's ``positives`` best rows of its label:
    the first ``negatives`` rows of other labels with ``low`` to ``high`` per cent of its score.
    """
    ship(vectors.sparkSession)
    with scratch(vectors.sparkSession):
        rows = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0")
        rows = stored(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "vector", F.size("vector").alias("size"),
                                  is_anchor.alias("asked"), F.monotonically_increasing_id().alias("row")))
        many = lambda n: F.greatest(F.lit(1), F.ceil(n * F.col("size") / COMPONENTS)).cast("int")
        sizes = stored(rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).where("m > 0")
                       .select("size", many(F.col("n")).alias("shards"), many(F.col("m")).alias("blocks")))
        rows = lookup(rows, sizes, ["size"], "inner", F.col("row"))
        asked = rows.where("asked").withColumnRenamed("row", "anchor").withColumn("block", _dealt(rows, "anchor", "blocks"))
        asked = stored(asked.select("size", "block", "shards", "anchor", "vec_id", "label", "vector"))
        to_shards = lambda some: some.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        cells = rows.withColumn("shard", _dealt(rows, "row", "shards"))
        cells = cells.select("size", "shard", "vec_id", "label", "vector", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        cell = ["size", "shard", "block"]
        near = cells.groupBy(*cell).cogroup(to_shards(asked).groupBy(*cell)).applyInArrow(_positives(positives), _PAIR_ROWS)
        best = stored(top_k(stored(near), "anchor", F.lit(positives), F.col("score").desc(), F.col("vec_id")).select("anchor", "anchor_id", "vec_id", "score"))
        known = best.groupBy("anchor").agg(F.collect_list("score").alias("positives"))  # at most ``positives`` an anchor
        # repeated for the shards after the join: Spark takes repeated rows for as small as their files and would broadcast them
        known = asked.join(known.hint("merge"), "anchor")
        far = cells.groupBy(*cell).cogroup(to_shards(known).groupBy(*cell)).applyInArrow(_candidates(negatives, low, high), _PAIR_ROWS)
        keys = stored(_packed(best, _POSITIVE).union(_packed(far, _NEGATIVE)), keep=True)
    return keys.repartition("anchor").sortWithinPartitions("key").select("anchor", "anchor_id", "key").mapInArrow(_emit(negatives, low, high), _MINED)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, c.row, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
