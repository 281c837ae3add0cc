"""Embedding windows, pooling, and cosine top-k."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ranking import top_k
from ..functions.sizing import broadcast_if
from ..session import scratch, ship, stored

# fixed value: window size; the embedding service itself reads three windows
WINDOW_CHARS = 10_000
_DIGITS = 9
#: Components of a shard or block, and scores (chunks by queries) that a task holds at once.
COMPONENTS, SCORES = 1 << 18, 4_000_000


def embedding_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", window_chars: int = WINDOW_CHARS,
                      max_windows: int | None = None) -> DataFrame:
    """Consecutive windows of a text; none for empty text. ``max_windows`` leaves out what lies behind the last."""
    n = F.ceil(F.length(text) / window_chars).cast("int")
    n = n if max_windows is None else F.least(F.lit(max_windows), n)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.substring(F.col(text), i * window_chars + 1, F.lit(window_chars)))
    return docs.select(key, F.posexplode(windows).alias("window", "window_text"))


def vector_norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


#: Keys whose sums a task holds at once, and the parts of a whole number that are added up apart.
KEYS, _SCALE, _LOW = 50_000, 1e12, 30


def _vector_sums(key: str, key_type: pa.DataType):
    """Kernel: one row of sums for each key that a task sees: count and whole sums (high and low part) of each component.

    Components count in units of 1e-12, as whole numbers, so that sums do not depend on their order.
    """
    schema = pa.schema([(key, key_type), ("windows", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def out(held: dict) -> pa.RecordBatch:
        n, high, low = zip(*held.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(list(held), key_type), pa.array(n, pa.int64()), pa.array(list(high), schema.field(2).type), pa.array(list(low), schema.field(3).type)], schema=schema)

    def add(held: dict, name, n: int, high: np.ndarray, low: np.ndarray) -> None:
        old = held.get(name)
        if old is None:
            held[name] = [n, high, low]
        elif len(old[1]) != len(high):
            raise ValueError(f"vectors of {len(old[1])} and of {len(high)} components under one {key}")
        else:
            old[0], old[1], old[2] = old[0] + n, old[1] + high, old[2] + low

    def rows_of(batch: pa.RecordBatch):
        """Key codes and matrix of the vectors of each size in a batch."""
        sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
        for size in np.unique(sizes[sizes > 0]).tolist():
            some = batch.take(pa.array(np.flatnonzero(sizes == size)))
            yield some.column(0), np.asarray(some.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)

    def run(batches):
        held: dict = {}
        for batch in batches:
            for names, matrix in rows_of(batch):
                whole = np.rint(matrix * _SCALE).astype(np.int64)
                codes = names.dictionary_encode()
                of = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False)
                order = np.argsort(of, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0))
                high, low = (np.add.reduceat(x[order], starts) for x in (whole >> _LOW, whole & (1 << _LOW) - 1))
                for code, n, h, x in zip(of[order][starts].tolist(), np.diff(np.append(starts, len(of))).tolist(), high, low, strict=True):
                    add(held, codes.dictionary[code].as_py() if code >= 0 else None, n, h, x)
                if len(held) > KEYS:
                    yield out(held)
                    held = {}
        if held:
            yield out(held)

    def merge(batches):
        """Of rows sorted by key: one row for each."""
        held: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                if held and row[key] not in held:
                    yield out(held)
                    held = {}
                add(held, row[key], row["windows"], np.array(row["high"]), np.array(row["low"]))
        if held:
            yield out(held)

    return run, merge


def pool_embeddings(vectors: DataFrame, key: str, renorm: bool = True) -> DataFrame:
    """Mean vector per key, rescaled to unit length.

    A single window is returned as it is. Tasks add up whole vectors before the shuffle, so
    it moves one row for each task and key, whatever the number of vectors and components.
    Null and empty vectors take no part; a key whose vectors differ in size is an error.
    """
    spark, field = vectors.sparkSession, vectors.schema[key]
    ship(spark)
    key_type = to_arrow_type(field.dataType)
    run, merge = _vector_sums(key, key_type)
    schema = T.StructType([field, T.StructField("windows", T.LongType()), T.StructField("high", T.ArrayType(T.LongType())), T.StructField("low", T.ArrayType(T.LongType()))])
    sums = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, schema)
    sums = sums.repartition(key).sortWithinPartitions(key).mapInArrow(merge, schema)
    total = lambda h, x: (h.cast("decimal(38,0)") * F.lit(1 << _LOW).cast("decimal(12,0)") + x.cast("decimal(20,0)")).cast("double") / _SCALE
    mean = F.transform(F.arrays_zip("high", "low"), lambda z: total(z["high"], z["low"]) / F.col("windows"))
    pooled = sums.select(key, "windows", mean.alias("embedding"))
    if not renorm:
        return pooled
    norm = vector_norm(F.col("embedding"))
    scaled = F.transform("embedding", lambda x: x / F.col("_norm"))
    return (
        pooled.withColumn("_norm", F.when((F.col("windows") == 1) | (norm == 0), 1.0).otherwise(norm))
        .withColumn("embedding", scaled)
        .drop("_norm")
    )


def first_scores(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best scores of each row, ties to the smaller column; all rows at once."""
    if scores.shape[1] > k:
        edge = np.partition(scores, -k, axis=1)[:, -k]
        row, col = np.nonzero(scores >= edge[:, None])
    else:
        row, col = np.nonzero(np.ones(scores.shape, bool))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[keep], col[keep]


def _unit_rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    rows = np.asarray(column.combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    norms = np.linalg.norm(rows, axis=1)
    norms[norms == 0] = 1.0
    return rows / norms[:, None]


def _buckets(rows: np.ndarray, bucket_length: float, tables: int) -> np.ndarray:
    """Bucket of each row in each table: its projection on a random direction, in steps of ``bucket_length``."""
    directions = np.random.default_rng(7).normal(size=(rows.shape[1], tables))
    return np.floor(rows @ (directions / np.linalg.norm(directions, axis=0)) / bucket_length).astype(np.int32)


def _cosine_cell(id_type: pa.DataType, held_scores: int, lsh: tuple[float, int, float] | None = None):
    """Kernel over a shard of chunk vectors and a block of query vectors: the best of the shard for each query.

    With ``lsh`` (bucket length, tables, greatest distance) only pairs that share a bucket of a table and lie nearer than that.
    """

    def run(key: tuple, chunks: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", id_type), ("frame_id", pa.string()), ("score", pa.float64())])
        if not chunks.num_rows or not queries.num_rows:
            return schema.empty_table()
        chunks = chunks.sort_by("frame_id")  # columns in the order that settles ties
        matrix, asked = _unit_rows(chunks.column("embedding"), chunks.num_rows), _unit_rows(queries.column("embedding"), queries.num_rows)
        if lsh:
            length, tables, distance = lsh
            own, other = _buckets(matrix, length, tables), _buckets(asked, length, tables)
        ks = queries.column("_k").to_numpy()
        parts, step = [], max(1, held_scores // chunks.num_rows)
        for a in range(0, queries.num_rows, step):  # the score matrix stays bounded
            scores = np.round(matrix @ asked[a:a + step].T, _DIGITS).T
            if lsh:
                meet = np.zeros(scores.shape, bool)
                for t in range(tables):
                    meet |= other[a:a + step, t, None] == own[None, :, t]
                scores[~(meet & (2 - 2 * scores < distance * distance))] = -np.inf
            row, col = first_scores(scores, int(ks[a:a + step].max()))
            found = np.isfinite(scores[row, col])
            row, col = row[found], col[found]
            parts.append(pa.table([queries.column("query_id").take(pa.array(a + row)), chunks.column("frame_id").take(pa.array(col)), pa.array(scores[row, col])], schema=schema))
        return pa.concat_tables(parts)

    return run


def cosine_topk(query_vecs: DataFrame, chunk_vecs: DataFrame, k: Column, mode: str = "exact",
                components: int = COMPONENTS, bucket_length: float = 0.8, tables: int = 8,
                max_distance: float = 1.5) -> DataFrame:
    """(query_id, frame_id, score, rank) of the best k chunks by cosine.

    ``exact``: chunk vectors are dealt to shards and query vectors to blocks of a bounded number of
    ``components``; a shard meets each block in one task, which returns its best k. Vectors meet
    those of their own size; see ``unmatched_vectors`` for the rest. ``lsh``: approximate, by random
    projection buckets, which are made and met in the same cells: vectors move once a block, not once
    a table, and no pair leaves its task but the best.
    """
    spark = query_vecs.sparkSession
    ship(spark)
    queries = query_vecs.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), k.cast("int").alias("_k"))
    lsh = (bucket_length, tables, max_distance) if mode == "lsh" else None
    id_field = queries.schema["query_id"]
    schema = T.StructType([id_field, T.StructField("frame_id", T.StringType()), T.StructField("score", T.DoubleType())])
    id_type = pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.string()
    with scratch(spark):
        asked = stored(queries.where(F.size("embedding") > 0).withColumn("dim", F.size("embedding")))
        chunks = stored(chunk_vecs.select(F.col("frame_id").cast("string").alias("frame_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim")).where("dim > 0"))
        parts = lambda df, name: df.groupBy("dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * F.first("dim") / components)).cast("int").alias(name))
        sizes = stored(parts(asked, "blocks").join(parts(chunks, "shards"), "dim"))  # a row for each size of vectors
        sizes = broadcast_if(sizes, sizes.count(), 32)
        dealt = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        # repeated names are told apart by their vectors, so that no shard grows with one name
        left = chunks.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("frame_id", "embedding"), F.col("shards")).cast("int")).withColumn("block", every("blocks"))
        right = asked.join(sizes, "dim").withColumn("block", dealt("query_id", "blocks")).withColumn("shard", every("shards"))
        cell = ["dim", "shard", "block"]
        found = left.select(*cell, "frame_id", "embedding").groupBy(*cell).cogroup(right.select(*cell, "query_id", "embedding", "_k").groupBy(*cell)).applyInArrow(
            _cosine_cell(id_type, SCORES, lsh), schema)
        found = stored(found, keep=True)
    ranked = found.join(queries.select("query_id", "_k"), "query_id")
    return top_k(ranked, "query_id", F.col("_k"), F.col("score").desc(), F.col("frame_id")).select("query_id", "frame_id", "score", "rank")


def unmatched_vectors(query_vecs: DataFrame, chunk_vecs: DataFrame) -> DataFrame:
    """Sizes of chunk vectors that no query has, with their number: chunks that a search cannot find."""
    asked = query_vecs.select(F.size("embedding").alias("dim")).distinct()
    return chunk_vecs.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).join(asked, "dim", "left_anti")
