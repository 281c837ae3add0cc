"""Term index and BM25 top-k for whole batches of queries.

``LexicalIndex`` holds each chunk with its term counts. ``InvertedIndex`` is what a search reads:
each task cuts its chunks to shards and numbers them in the order of their names; a row holds the postings of a
term in a shard, in blocks with their greatest gains. Tasks write their rows to folders by the hash of the
term, nothing is shuffled, so a search opens only the folders of its terms. Its terms meet the postings in a join, and
the postings of a shard meet the queries in one task, which scores whole chunks and returns its best.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import top_k
from ..functions.sizing import broadcast_if
from ..session import scratch, ship, stored, stored_by

K1, B = 1.2, 0.75
_UNITS = 1_000_000  # scores add up in whole millionths, so that the order of the sum does not matter
#: Chunks and postings of a shard at most; postings of a block; query terms that meet a shard in one task; words counted at once.
SHARD_CHUNKS, SHARD_POSTINGS, BLOCK, BLOCK_TERMS, COUNT_WORDS = 8192, 1 << 21, 128, 200_000, 1 << 20
#: Folders of an index: one for this many chunks, within these bounds. With that of the names a task can hold all open at once (``session.open_files``).
BUCKET_CHUNKS, BUCKETS = 8192, (8, 15)
#: Rows that leave a task at once.
OUT_ROWS = 20_000
_NAMES = -1  # the folder of the chunks' names


@dataclass
class LexicalIndex:
    """``entries`` has one row per chunk."""

    entries: DataFrame  # frame_id, doc_len, terms: array of (term, tf)
    term_df: DataFrame  # term, df
    stats: DataFrame  # one row: n_chunks, avg_len
    words: DataFrame | None = None  # frame_id and the words that entries are counted from, where they are at hand

    @property
    def postings(self) -> DataFrame:
        """term, frame_id, tf, doc_len."""
        return self.entries.select("frame_id", "doc_len", F.inline("terms")).select("term", "frame_id", "tf", "doc_len")


@dataclass
class InvertedIndex:
    """``rows`` (by bucket): a term's postings in a shard; in the folder of names the names of a shard's chunks, in order, and their lengths."""

    rows: DataFrame  # bucket, shard, term, n, ords, tfs, lens, peaks (greatest gain of each block, if asked for), names
    stats: DataFrame  # one row: n_chunks, avg_len, buckets

    @property
    def lists(self) -> DataFrame:
        return self.rows.where("term IS NOT NULL").drop("names")  # a filter on the folder itself would keep Spark from choosing folders by the join

    @property
    def names(self) -> DataFrame:
        """shard, ord, frame_id."""
        return self.rows.where(F.col("bucket") == _NAMES).select("shard", F.posexplode("names").alias("ord", "frame_id"))

    @property
    def postings(self) -> DataFrame:
        """term, frame_id, tf, doc_len."""
        zipped = F.inline(F.arrays_zip("ords", "tfs", "lens"))
        return self.lists.select("shard", "term", zipped).join(self.names.withColumnRenamed("ord", "ords"), ["shard", "ords"]).select(
            "term", "frame_id", F.col("tfs").cast("long").alias("tf"), F.col("lens").cast("long").alias("doc_len"))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over chunks and their words: doc_len and the array of (term, tf) of each."""
    for batch in batches:
        many = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in _runs(many, batch.num_rows, COUNT_WORDS):
            part = batch.slice(a, b - a)
            words = part.column(1).flatten().dictionary_encode()
            size = max(1, len(words.dictionary))
            key, tfs = np.unique(np.repeat(np.arange(b - a), many[a:b]) * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
            starts = np.append(0, np.cumsum(np.bincount(key // size, minlength=b - a)))
            terms = pa.StructArray.from_arrays([words.dictionary.take(pa.array(key % size)).cast(pa.string()), pa.array(tfs.astype(np.int64))], ["term", "tf"])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(many[a:b].astype(np.int64)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), terms)], names=["frame_id", "doc_len", "terms"])


def _runs(weights: np.ndarray, most: int, weight: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``most`` items and, but for a single item, at most ``weight`` together."""
    ends, a = np.cumsum(weights), 0
    while a < len(weights):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, min(a + most, int(np.searchsorted(ends, before + weight, "right"))))
        yield a, b
        a = b


def index_of(entries: DataFrame) -> LexicalIndex:
    """Index over its entries. Only document frequencies are shuffled, after map-side counts."""
    return LexicalIndex(
        entries=entries,
        term_df=entries.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df")),
        stats=entries.agg(F.count("*").alias("n_chunks"), F.avg("doc_len").alias("avg_len")),
    )


def build_lexical_index(chunks: DataFrame, key: str = "frame_id") -> LexicalIndex:
    """Index of title and whole content; ``key`` names the chunk."""
    ship(chunks.sparkSession)
    words = chunks.select(F.col(key).alias("frame_id"), tokens(F.concat_ws(" ", "title", "content")).alias("_words"))
    index = index_of(words.mapInArrow(counted, "frame_id string, doc_len long, terms array<struct<term:string,tf:bigint>>"))
    return replace(index, words=words)


def _gain(tf: np.ndarray, length: np.ndarray, avg_len: float) -> tuple[np.ndarray, np.ndarray]:
    """Parts of a posting's gain, which is idf * first / second."""
    return tf * (K1 + 1), tf + K1 * (1 - B + B * length / avg_len)


_ROWS = "shard long, term string, n int, ords array<int>, tfs array<int>, lens array<int>, peaks array<double>, names array<string>"


def _invert_kernel(avg_len: float | None, shard_chunks: int):
    """Kernel over the entries of a task, which it cuts to shards: for each a row for each of its terms, and one with its names and lengths. No peaks without ``avg_len``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, chunks, postings = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            many = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for a, b in _runs(many, shard_chunks, SHARD_POSTINGS):
                more = int(many[a:b].sum())
                if held and (chunks + b - a > shard_chunks or postings + more > SHARD_POSTINGS):
                    yield from shard(number, held).to_batches(OUT_ROWS)
                    number, chunks, postings = number + 1, 0, 0
                held.append(batch.slice(a, b - a))
                chunks, postings = chunks + b - a, postings + more
        if held:
            yield from shard(number, held).to_batches(OUT_ROWS)

    def shard(number: int, held: list[pa.RecordBatch]) -> pa.Table:
        """Rows of the entries that are held, which are let go once their numbers are read."""
        names = [name for batch in held for name in batch.column(0).to_pylist()]
        order = sorted(range(len(names)), key=lambda i: (names[i] is not None, names[i] or ""))
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names), dtype=np.int32)
        lengths = np.concatenate([batch.column(1).to_numpy() for batch in held]).astype(np.int32)
        many = np.concatenate([batch.column(2).value_lengths().to_numpy(zero_copy_only=False) for batch in held])
        flat = [batch.column(2).flatten() for batch in held]
        words = pa.concat_arrays([x.field("term") for x in flat]).dictionary_encode()
        tfs = np.concatenate([x.field("tf").to_numpy(zero_copy_only=False) for x in flat]).astype(np.int32)
        terms, dictionary = words.indices.to_numpy(zero_copy_only=False), words.dictionary
        held.clear()
        del flat, words
        ords = rank[np.repeat(np.arange(len(names), dtype=np.int32), many)]
        turn = np.lexsort((ords, terms))
        counts = np.bincount(terms, minlength=len(dictionary))
        starts = np.append(0, np.cumsum(counts))
        ords, tfs = ords[turn], tfs[turn]
        del terms, turn
        lengths = lengths[order]
        lens = lengths[ords]
        of = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        n = len(counts)
        if avg_len is None:
            peaks = pa.nulls(n, pa.list_(pa.float64()))
        else:
            first, second = _gain(tfs.astype(np.float64), lens, avg_len)
            blocks = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts, starts[1:], strict=False)]) if n else np.empty(0, np.int64)
            peaks = of(np.append(0, np.cumsum(-(-counts // BLOCK))), np.maximum.reduceat(first / second, blocks) if n else np.empty(0))
        found = pa.table({"shard": pa.array(np.full(n, number, np.int64)), "term": dictionary.cast(pa.string()), "n": pa.array(counts.astype(np.int32)),
                          "ords": of(starts, ords), "tfs": of(starts, tfs), "lens": of(starts, lens), "peaks": peaks, "names": pa.nulls(n, pa.list_(pa.string()))})
        own = {"shard": pa.array([number], pa.int64()), "names": pa.array([[names[i] for i in order]], pa.list_(pa.string())), "lens": pa.array([lengths], pa.list_(pa.int32()))}
        return pa.concat_tables([found, pa.table({f.name: own.get(f.name, pa.nulls(1, f.type)) for f in found.schema}, schema=found.schema)])

    return run


def invert(index: LexicalIndex, folder: str | None = None, keep: bool = False, shard_chunks: int = SHARD_CHUNKS, peaks: bool = True) -> InvertedIndex:
    """Write the postings by term. ``folder`` names the place; without one it is a table of the open scope (``keep``: of the one around).

    Peaks need the average length before the first shard is written, for which all words are counted once more.
    """
    spark = index.entries.sparkSession
    ship(spark)
    source = index.entries.select("frame_id", "doc_len", "terms") if index.words is None else index.words
    row = index.stats.first() if peaks else None
    n = row["n_chunks"] if peaks else source.count()
    buckets = min(BUCKETS[1], max(BUCKETS[0], -(-n // BUCKET_CHUNKS)))
    # a task makes its own shards and writes them, so nothing is shuffled; results do not depend on the shards
    kernel = _invert_kernel((row["avg_len"] or 1.0) if peaks else None, shard_chunks)
    # words are counted and inverted by one worker; entries do not leave it
    rows = source.mapInArrow(kernel if index.words is None else lambda batches: kernel(counted(batches)), _ROWS)
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(_NAMES)).otherwise(bucket_of(F.col("term"), buckets)))
    written = stored_by(rows, "bucket", keep, folder and f"{folder}/rows")
    total = F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x))
    stats = written.where(F.col("bucket") == _NAMES).agg(
        F.coalesce(F.sum(F.size("names")), F.lit(0)).alias("n_chunks"), (total / F.sum(F.size("names"))).alias("avg_len"), F.lit(buckets).alias("buckets"))
    return InvertedIndex(written, stored(stats, keep, folder and f"{folder}/stats"))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write_lexical_index(index: LexicalIndex, folder: str) -> None:
    invert(index, folder)


def read_lexical_index(spark, folder: str) -> InvertedIndex:
    return InvertedIndex(*(spark.read.parquet(f"{folder}/{t}") for t in ("rows", "stats")))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


class _Term:
    """Postings of one term in a shard, with their gains in millionths; ``peaks`` are worked out where they are not known."""

    def __init__(self, ords: np.ndarray, tfs: np.ndarray, lens: np.ndarray, peaks: np.ndarray | None, idf: float, avg_len: float):
        first, second = _gain(tfs.astype(np.float64), lens, avg_len)
        self.ords, self.gains = ords, np.floor(idf * first / second * _UNITS + 0.5).astype(np.int64)
        # no gain of the block is above
        self.peaks = np.maximum.reduceat(self.gains, np.arange(0, len(ords), BLOCK)) if peaks is None else np.floor(idf * peaks * _UNITS + 1.5).astype(np.int64)
        self.peak = int(self.peaks.max(initial=0))

    def of(self, chunks: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the chunks (sorted) have the term, and its gains; blocks whose greatest gain is below a chunk's room are not read."""
        at = np.searchsorted(self.ords, chunks)
        near = np.flatnonzero(at < len(self.ords))
        near = near[self.peaks[at[near] // BLOCK] >= room[near]]
        hit = near[self.ords[at[near]] == chunks[near]]
        return hit, self.gains[at[hit]]


#: A sum holds the score above these bits and the number of terms in them, so that a chunk with a score of zero counts as found.
_COUNT_BITS = 20


def best_chunks(terms: list[_Term], n_chunks: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the k best chunks of a shard, by score and then number.

    Terms go in by descending peak. Once the kth score is above what all later terms together can
    give, no new chunk can come in: the later terms are looked up for the chunks that can still reach it.
    """
    terms = sorted(terms, key=lambda t: -t.peak)
    rest = np.append(np.cumsum([t.peak for t in terms][::-1])[::-1], 0).tolist()
    sums = np.zeros(n_chunks, np.int64)
    for i, t in enumerate(terms):
        if i and int(sums.max()) >> _COUNT_BITS > rest[i]:
            scores = sums >> _COUNT_BITS
            kth = int(np.partition(scores, -k)[-k]) if n_chunks >= k else 0
            if kth > rest[i]:
                chunks = np.flatnonzero(scores + rest[i] >= kth)
                for j in range(i, len(terms)):
                    hit, gains = terms[j].of(chunks, kth - (sums[chunks] >> _COUNT_BITS) - rest[j + 1])
                    sums[chunks[hit]] += (gains << _COUNT_BITS) + 1
                break
        sums[t.ords] += (t.gains << _COUNT_BITS) + 1
    found = np.flatnonzero(sums)
    scores = sums[found] >> _COUNT_BITS
    if len(found) > k:
        edge = np.partition(scores, -k)[-k]
        keep = scores >= edge
        found, scores = found[keep], scores[keep]
    order = np.lexsort((found, -scores))[:k]
    return found[order], scores[order]


def _search_kernel(k: int, avg_len: float, id_type: pa.DataType):
    """Kernel over a shard's postings of the asked terms and a block of query terms."""

    def run(key: tuple, lists: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", id_type), ("shard", pa.int64()), ("ord", pa.int32()), ("score", pa.int64())])
        if not lists.num_rows or not asked.num_rows:
            return schema.empty_table()
        lists = lists.combine_chunks()
        words = lists.column("term").to_pylist()
        at = {w: i for i, w in enumerate(words)}
        columns = {}
        for c in ("ords", "tfs", "lens"):
            column = lists.column(c).combine_chunks()
            columns[c] = (column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
        part = lambda c, i: columns[c][0][columns[c][1][i]:columns[c][1][i + 1]]
        n_chunks = int(columns["ords"][0].max()) + 1
        asked = asked.sort_by("query_id")
        ids = asked.column("query_id").combine_chunks().dictionary_encode()
        of = ids.indices.to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)).tolist()
        terms, idf = asked.column("term").to_pylist(), asked.column("idf").to_pylist()
        made: dict[int, _Term] = {}
        queries, chunks, scores = [], [], []
        for a, b in zip(edges, edges[1:], strict=False):
            own = []
            for w, x in zip(terms[a:b], idf[a:b], strict=True):
                i = at.get(w)
                if i is not None:
                    if i not in made:
                        made[i] = _Term(*(part(c, i) for c in ("ords", "tfs", "lens")), None, x, avg_len)
                    own.append(made[i])
            if own:
                found, score = best_chunks(own, n_chunks, k)
                queries.append(np.full(len(found), a))
                chunks.append(found)
                scores.append(score)
        if not queries:
            return schema.empty_table()
        query = asked.column("query_id").take(pa.array(np.concatenate(queries)))
        chunk = np.concatenate(chunks).astype(np.int32)
        return pa.table([query, pa.array(np.full(len(chunk), key[0].as_py(), np.int64)), pa.array(chunk), pa.array(np.concatenate(scores))], schema=schema)

    return run


def asked_lists(asked: DataFrame, index: InvertedIndex, n_terms: int) -> DataFrame:
    """Postings of the asked terms (bucket, term, more; ``n_terms`` of them at most). While these are few they are broadcast and Spark opens only their folders."""
    return index.lists.join(broadcast_if(asked.where("term <> ''"), n_terms, 64), ["bucket", "term"])


def bm25_topk(queries: DataFrame, index: LexicalIndex | InvertedIndex, k: Column, largest_k: int) -> DataFrame:
    """(query_id, frame_id, score, rank) of the best k chunks of each query.

    ``largest_k`` bounds every k. Query terms are a table throughout: they find their postings, and meet
    every shard in blocks of a bounded number. Only a shard's best chunks of a query are shuffled.
    """
    ship(queries.sparkSession)
    if isinstance(index, LexicalIndex):
        index = invert(index)
    row = index.stats.first()
    n, avg_len = row["n_chunks"], row["avg_len"] or 1.0
    id_field = queries.schema["query_id"]
    id_type = pa.int64() if isinstance(id_field.dataType, T.LongType) else pa.string()
    schema = T.StructType([T.StructField("query_id", id_field.dataType), T.StructField("shard", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("score", T.LongType())])
    with scratch(queries.sparkSession):
        terms = stored(query_terms(queries).withColumn("bucket", bucket_of(F.col("term"), row["buckets"])))
        n_terms = terms.count()
        distinct = terms.select("bucket", "term").distinct()
        found = stored(asked_lists(distinct, index, n_terms).select("shard", "term", "n", "ords", "tfs", "lens"))
        idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        weights = found.groupBy("term").agg(F.sum("n").alias("df")).select("term", idf.alias("idf"))
        blocks = max(1, -(-n_terms // BLOCK_TERMS))
        asked = stored(terms.join(weights, "term").select("query_id", "term", "idf", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")))
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        cells = found.withColumn("block", every(blocks)) if blocks > 1 else found.withColumn("block", F.lit(0))
        meet = asked.crossJoin(F.broadcast(stored(found.select("shard").distinct())))  # a row for each shard
        best = stored(cells.groupBy("shard", "block").cogroup(meet.groupBy("shard", "block")).applyInArrow(_search_kernel(largest_k, avg_len, id_type), schema), keep=True)
    named = index.names.join(broadcast_if(best, best.count(), 48), ["shard", "ord"])
    named = named.select("query_id", "frame_id", (F.col("score") / _UNITS).alias("score"))
    ranked = top_k(named, "query_id", F.lit(largest_k), F.col("score").desc(), F.col("frame_id"))
    return (
        ranked.join(queries.select("query_id", k.alias("_k")), "query_id")
        .where(F.col("rank") <= F.col("_k"))
        .select("query_id", "frame_id", "score", "rank")
    )
