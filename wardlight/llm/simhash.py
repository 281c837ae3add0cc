"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has 64 bits; two are linked if at most ``distance`` bits differ. Cut
into ``blocks`` blocks, linked fingerprints agree on at least ``blocks - distance``
of them, so every choice of that many blocks is a join key and no link is lost. Only
distinct fingerprints are keyed, each with its least doc_id. Within a key, pairs are
compared by Hamming distance in blocks of vectors and only a spanning forest of the
links leaves the task. A key with more than ``CHUNK`` members is dealt in chunks, a
task for each pair of chunks.

``near_duplicates`` links by that distance alone. ``one_of_each`` is for cleaning a
corpus, where near copies share at least 0.8 of their distinct five-word shingles. Prints
only give candidates there: a print of the single words is cut into blocks, 16 keys come
from the least hashes of the shingles, which added passages move as little as scattered
edits, and prints of 256 bits over the shingles must not be far apart. Texts of one component of candidates are
then linked if their sets of shingles, compared whole, share enough.

Rows without doc_id take no part. A null or empty text has fingerprint zero, which
links like any other. Rows that repeat a doc_id are one node: they are linked. Only
doc_id and text are read; an empty table gives no rows.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship, stored
from .columns import BROADCAST_ROWS, sieved, without
from .components import components
from .windows import Words, mix, parts, words_of

DISTANCE, BLOCKS, SHINGLE, SEED = 3, 6, 3, 42
#: For near copies: words of a shingle; bits that may differ in the print of words, and its blocks.
COPY_SHINGLE, COPY_DISTANCE, COPY_BLOCKS = 5, 5, 7
#: Bits over the shingles that may differ, of 256 in a candidate and of 128 in a component. At 0.8 the means are 38.8 and 19.4 with deviations of 5.7 and 4.1, so 7 and 6 deviations;
#: for sets of 5 and 4 shingles, which differ most, 48 and 24 with 6.2 and 4.4, so 5 and 4.5. Unrelated texts, whose pairs grow with the square of the input, have 128 with 8 and 64 with
#: 5.7: 2 of 10,000 of their pairs are within 44 of 128 bits, 1 of 1,000 million within 80 of 256. Per cent of all distinct shingles of two texts that are in both.
COPY_BITS, COPY_REACH, COPY_PERCENT = 80, 44, 80
PROOF = ("p0", "p1", "p2", "p3")
_SEEDS = np.array([0, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D], np.uint64)
#: Keys from least hashes of the shingles, and least hashes a key.
COPY_KEYS, COPY_LEAST = 16, 4
_ORDERS = mix(np.arange(1, COPY_KEYS * COPY_LEAST + 1, dtype=np.uint64)) | np.uint64(1)
#: Shingles of a chunk of a component, and members that go to all of its chunks.
GRAMS, MIDDLES = 1 << 22, 16
#: Members of a key that are compared in one task; a pair of chunks has twice as many.
CHUNK = 2048
#: Links held before they are reduced to a forest.
LINKS = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half the XXH64 values of the text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1)[shingle - 1:].tolist() or [len(line)]
    hashes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends, strict=False)], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(kernel, "doc_id long, fp long")


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Bit masks (signed) of every choice of blocks that must hold an agreeing one."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    found = [sum(c) for c in combinations(block, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


class _Forest:
    """Roots of positions 0..n-1 under links that come in batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[a], root[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root[:] = up


def forest(group: np.ndarray, fp: np.ndarray, distance: int, proof: list[np.ndarray] = (), proof_distance: int = 0) -> np.ndarray:
    """Root position of each row; rows are sorted by group and linked only within it, if the proofs are near as well."""
    n = len(fp)
    found, held_a, held_b, held = _Forest(n), [], [], 0
    end = np.searchsorted(group, group, "right")
    here = np.arange(n)
    step = 1
    while True:
        here = here[here + step < end[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(fp[here] ^ fp[here + step]) <= distance]
        if len(proof):
            near = near[sum(np.bitwise_count(p[near] ^ p[near + step]).astype(np.int64) for p in proof) <= proof_distance]
        held_a.append(near)
        held_b.append(near + step)
        held += len(near)
        if held > LINKS:
            found.add(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [], [], 0
        step += 1
    if held:
        found.add(np.concatenate(held_a), np.concatenate(held_b))
    return found.root


def _links(distance: int, proof_distance: int):
    """Kernel over rows sorted by group (mask, key, i, j): links of each row to the root of its forest."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(p) for p in zip(held, columns, strict=True)]
            new = np.ones(len(columns[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            held = [c[last:] for c in columns]
            if last:
                yield _edges([c[:last] for c in columns], new[:last], distance, proof_distance)
        if held is not None and len(held[0]):
            new = np.zeros(len(held[0]), bool)
            yield _edges(held, new, distance, proof_distance)

    return kernel


def _edges(columns: list[np.ndarray], new: np.ndarray, distance: int, proof_distance: int) -> pa.RecordBatch:
    group, fp, doc = np.cumsum(new), columns[4].view(np.uint64), columns[5]
    root = forest(group, fp, distance, [c.view(np.uint64) for c in columns[6:]], proof_distance)
    a, b = doc, doc[root]
    keep = a != b
    u, v = np.maximum(a, b)[keep], np.minimum(a, b)[keep]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(nodes: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, proof: tuple = (), proof_distance: int = 0) -> DataFrame:
    """u, v: links that connect all of ``nodes`` (fp, doc, proof columns) within the distances, without all pairs."""
    keyed = nodes.select("fp", "doc", *proof, F.posexplode(F.transform(F.array(*[F.lit(m) for m in masks(blocks, distance)]), lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "key"))
    return _within(keyed, distance, proof, proof_distance)


def _within(keyed: DataFrame, distance: int, proof: tuple = (), proof_distance: int = 0) -> DataFrame:
    """u, v: links within the distances between rows of equal mask and key."""
    # keys with more than CHUNK members; there are at most rows / CHUNK of them
    large = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
                   .select("mask", "key", F.ceil(F.col("n") / CHUNK).cast("int").alias("n")))
    dealt = keyed.join(large, ["mask", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    pairs = _dealt(dealt, F.col("doc")).select("mask", "key", "i", "j", "fp", "doc", *proof)
    group = ["mask", "key", "i", "j"]
    return pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(_links(distance, proof_distance), "u long, v long")


def _dealt(rows: DataFrame, by: Column) -> DataFrame:
    """Rows with a number n of chunks, once for each pair i, j of chunks that holds their own."""
    own = F.pmod(F.xxhash64(by), F.col("n").cast("long")).cast("int")
    both = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return both.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _reached(prints: DataFrame, distance: int, blocks: int) -> DataFrame:
    """component_id of every row of ``prints`` (doc_id, fp), a written table."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    edges = links(nodes, distance, blocks)
    # the rows of one repeated doc_id are one node
    repeated = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    own = prints.join(repeated, "doc_id").join(nodes, "fp").select(F.greatest("doc_id", "doc").alias("u"), F.least("doc_id", "doc").alias("v")).where("u > v")
    roots = components(edges.union(own))
    reached = nodes.join(roots, nodes.doc == roots.node, "left").select("fp", F.coalesce("root", "doc").alias("component_id"))
    return prints.join(stored(reached), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    ship(docs.sparkSession)
    with scratch(docs.sparkSession):
        return stored(_reached(stored(fingerprints(docs, shingle, seed)), distance, blocks).select("doc_id", "fp", "component_id"), keep=True)


def _majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts the bits set in over half of its hashes; rows of a text are next to each other."""
    found = np.zeros((n, 8), np.uint8)
    if len(hashes):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        many = np.diff(np.append(starts, len(hashes)))
        found[owner[starts]] = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little")
    return found.view("<i8").ravel()


def _shingle_sets(words: Words, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word shingles of each of n texts, sorted, and their text; of fewer words, the one over all of them."""
    grams = np.zeros(len(words.hashes), np.uint64)
    whole = np.append(words.text, np.full(shingle, -1))
    many = np.zeros(len(grams), np.int64)  # words of the shingle that lie in its text
    for k in range(shingle):
        here = whole[k:k + len(grams)] == words.text
        grams[here] = grams[here] * np.uint64(0x9E3779B97F4A7C15) + words.hashes[np.flatnonzero(here) + k]
        many += here
    first = np.append(True, words.text[1:] != words.text[:-1])[:len(grams)]
    keep = (many == shingle) | first
    grams, owner = mix(grams[keep]), words.text[keep]
    edges = np.searchsorted(owner, np.arange(n + 1))
    sets = [np.unique(grams[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    return np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(n), [len(x) for x in sets])


def _by_text(docs: DataFrame, values, schema: str, shingle: int) -> DataFrame:
    """Rows of ``docs`` (id, text) with what ``values`` makes of the words and shingles of a part of the texts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in parts(batch.column(batch.num_columns - 1)):
                words = words_of(data, offsets)
                own = [batch.column(k).slice(a, b - a) for k in range(batch.num_columns - 1)]
                columns = [*own, *values(words, *_shingle_sets(words, b - a, shingle), b - a)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.mapInArrow(kernel, schema)


def _proofs(grams: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
    return [pa.array(_majority(mix(grams ^ s) if s else grams, owner, n)) for s in _SEEDS]


def _totals(grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """One hash for each set of shingles."""
    sums = np.append(np.uint64(0), np.cumsum(mix(grams ^ np.uint64(0xA0761D6478BD642F))))
    edges = np.searchsorted(owner, np.arange(n + 1))
    return mix(sums[edges[1:]] - sums[edges[:-1]]).view(np.int64)


def copy_prints(docs: DataFrame, shingle: int = COPY_SHINGLE) -> DataFrame:
    """doc_id, t (hash of the text), fp (over single words), the proofs p0 to p3 (over distinct word shingles), doc (hash of the set of shingles) and keys."""

    def values(words: Words, grams: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
        fp = pa.array(_majority(words.hashes, words.text, n))
        return [fp, *_proofs(grams, owner, n), pa.array(_totals(grams, owner, n)), _keys(grams, owner, n)]

    text = F.coalesce("text", F.lit(""))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    return _by_text(rows, values, "doc_id long, t long, fp long, p0 long, p1 long, p2 long, p3 long, doc long, keys array<long>", shingle)


def _keys(grams: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """COPY_KEYS hashes of COPY_LEAST least values of a set each: two sets share such a value as often as they share shingles."""
    keys = np.zeros((n, COPY_KEYS), np.uint64)
    if len(grams):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        for k, m in enumerate(_ORDERS):
            c = k // COPY_LEAST
            keys[owner[starts], c] = mix(keys[owner[starts], c] ^ np.minimum.reduceat(grams * m, starts))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * COPY_KEYS), pa.array(keys.view(np.int64).ravel()))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first columns."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _near_pairs(p0: np.ndarray, p1: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions a < b and distance of pairs with near proofs and different labels, by blocks of rows."""
    for k in range(0, len(p0), 256):
        rows = slice(k, k + 256)
        apart = np.bitwise_count(p0[rows, None] ^ p0) + np.bitwise_count(p1[rows, None] ^ p1)
        a, b = np.nonzero((apart <= COPY_REACH) & (label[rows, None] != label))
        later = a + k < b
        a, b = a[later], b[later]
        yield (a + k).astype(np.int32), b.astype(np.int32), apart[a, b]


def _proven(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group (node, label, p0, p1, grams in the last columns) whose sets share enough; the nearest are tried first."""
    node, label, p0, p1 = (table.column(k).to_numpy() for k in range(-5, -1))
    column = table.column(-1).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets, grams = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(offsets)
    found = [np.concatenate(x) for x in zip(*_near_pairs(p0.view(np.uint64), p1.view(np.uint64), label), strict=True)]
    a, b, apart = found
    fits = 100 * np.minimum(size[a], size[b]) >= COPY_PERCENT * np.maximum(size[a], size[b])
    order = np.argsort(apart[fits], kind="stable")
    a, b = a[fits][order], b[fits][order]
    joined = _Forest(len(node))
    _, first, same = np.unique(label, return_index=True, return_inverse=True)
    joined.add(np.arange(len(node)), first[same])
    u, v = [], []
    for k in range(0, len(a), 4096):
        left = joined.root[a[k:k + 4096]] != joined.root[b[k:k + 4096]]
        for x, y in zip(a[k:k + 4096][left].tolist(), b[k:k + 4096][left].tolist(), strict=True):
            if joined.root[x] != joined.root[y]:
                both = len(np.intersect1d(grams[offsets[x]:offsets[x + 1]], grams[offsets[y]:offsets[y + 1]], assume_unique=True))
                if 100 * both >= COPY_PERCENT * (size[x] + size[y] - both):
                    joined.add(np.array([x]), np.array([y]))
                    u.append(x)
                    v.append(y)
    u, v = node[np.array(u, np.int64)], node[np.array(v, np.int64)]
    apart = u != v
    return np.maximum(u, v)[apart], np.minimum(u, v)[apart]


def _proven_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 3):
        if table.num_rows > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _proven(table)], names=["u", "v"])


def _middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cc, node, apart: the member of each chunk (cc, own, node, p0, p1) that is nearest to the majority of its bits."""
    for table in _groups(batches, 2):
        prints = np.stack([table.column(k).to_numpy() for k in (3, 4)], axis=1).view(np.uint8)
        bits = np.unpackbits(prints, axis=1)
        apart = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(bits))).sum(axis=1)
        k = int(np.argmin(apart))
        yield pa.RecordBatch.from_arrays([table.column(0).chunk(0)[k:k + 1], table.column(2).chunk(0)[k:k + 1], pa.array([int(apart[k])])], names=["cc", "node", "apart"])


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a pair of chunks (cc, i, j, node, label, p0, p1) that are near to one with another label."""
    for table in _groups(batches, 3):
        node, label, p0, p1 = (table.column(k).to_numpy() for k in range(3, 7))
        some = [np.unique(np.concatenate([a, b])) for a, b, _ in _near_pairs(p0.view(np.uint64), p1.view(np.uint64), label)]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[np.concatenate(some)]))], names=["node"])


def proven_links(members: DataFrame) -> DataFrame:
    """u, v: links that connect ``members`` (cc, node, p0, p1, grams; a written table) within each candidate component cc.

    A component beyond CHUNK members or GRAMS shingles is dealt in chunks. The members in
    the middle of it go to all chunks, which joins most copies of one text. Then members
    near to one that is still apart are dealt to pairs of chunks.
    """
    group, last = ["cc", "i", "j"], ["node", "label", "p0", "p1", "grams"]

    def proven(rows: DataFrame) -> DataFrame:
        return stored(rows.select(*group, *last).repartition(*group).sortWithinPartitions(*group).mapInArrow(_proven_links, "u long, v long"))

    def chunked(rows: DataFrame, size: Column) -> DataFrame:
        n = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum(size) / GRAMS), F.lit(1))
        return stored(rows.groupBy("cc").agg(n.cast("int").alias("n")).where("n > 1"))

    large = chunked(members, F.size("grams"))
    rows = members.join(large, "cc", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("n").cast("long")).cast("int")
    rows = rows.withColumn("i", own).withColumn("j", own).withColumn("label", F.col("node"))
    if not large.count():
        return proven(rows)
    some = rows.where("n > 1").select("cc", "i", "node", "p0", "p1")
    middles = some.repartition("cc", "i").sortWithinPartitions("cc", "i").mapInArrow(_middles, "cc long, node long, apart long")
    middles = stored(middles.groupBy("cc").agg(F.slice(F.sort_array(F.collect_list(F.struct("apart", "node"))), 1, MIDDLES).alias("m"))
                     .select("cc", F.explode("m.node").alias("node")))
    away = members.join(middles, ["cc", "node"]).join(large, "cc").withColumn("label", F.col("node"))
    away = away.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where(F.col("i") != F.pmod(F.xxhash64("node"), F.col("n").cast("long")))
    edges = proven(rows.select(*group, *last).union(away.withColumn("j", F.col("i")).select(*group, *last)))
    labels = stored(components(edges))
    named = rows.where("n > 1").select("cc", "n", "node", "p0", "p1").join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    named = stored(named.select("cc", "n", "node", "label", "p0", "p1"))
    mixed = stored(named.groupBy("cc").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("cc"))
    pairs = _dealt(named.join(mixed, "cc", "left_semi"), F.col("node")).select(*group, "node", "label", "p0", "p1")
    opened = stored(pairs.repartition(*group).sortWithinPartitions(*group).mapInArrow(_open_nodes, "node long").distinct())
    left = stored(members.join(opened, "node", "left_semi").join(named.select("node", "label"), "node"))
    dealt = left.join(chunked(left, F.size("grams")), "cc", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    return edges.union(proven(_dealt(dealt, F.col("node"))))


def copy_candidates(nodes: DataFrame) -> DataFrame:
    """u, v: pairs that connect all near copies among ``nodes`` (doc, fp, proofs, keys), and a few others."""
    keyed = nodes.select(F.lit(0).cast("long").alias("fp"), "doc", *PROOF, F.posexplode("keys").alias("mask", "key"))
    return links(nodes, COPY_DISTANCE, COPY_BLOCKS, PROOF, COPY_BITS).union(_within(keyed, 64, PROOF, COPY_BITS))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text) and the doc_id and t that stay for it (keep_id, keep_t), of every row with doc_id."""
    prints = stored(copy_prints(docs))
    nodes = stored(prints.groupBy("doc").agg(F.min(F.struct("doc_id", "t")).alias("least"), *[F.first(c).alias(c) for c in ("fp", *PROOF, "keys")]))
    near = components(stored(copy_candidates(nodes)))
    near = stored(near.select("node", F.col("root").alias("cc")).union(near.select("root", "root").distinct()))
    asked = stored(nodes.join(near, nodes.doc == near.node).select("cc", "node", "p0", "p1", "least.*"))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    if asked.count() > BROADCAST_ROWS:
        texts, _ = sieved(texts, asked.select("doc_id", "t"), ["doc_id", "t"])
    texts = texts.join(asked.select("doc_id", "t"), ["doc_id", "t"], "left_semi")

    def values(words: Words, grams: np.ndarray, owner: np.ndarray, n: int) -> list[pa.Array]:
        edges = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(edges), pa.array(grams.view(np.int64)))]

    sets = _by_text(texts, values, "doc_id long, t long, grams array<long>", COPY_SHINGLE)
    members = stored(asked.join(sets, ["doc_id", "t"]).select("cc", "node", "p0", "p1", "grams"))
    roots = components(proven_links(members))
    whole = stored(nodes.join(roots, nodes.doc == roots.node, "left").select("doc", "least", F.coalesce("root", "doc").alias("root")))
    first = stored(whole.groupBy("root").agg(F.min("least").alias("keep")))
    kept = stored(whole.join(first, "root").select("doc", F.col("keep.doc_id").alias("keep_id"), F.col("keep.t").alias("keep_t")))
    return prints.select("doc_id", "t", "doc").join(kept, "doc").drop("doc")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id (then text hash) of each group of near copies, columns as given.

    Of rows that repeat doc_id and text that whose columns come first as JSON stays; rows that repeat a doc_id
    with another text are judged by their text. Rows without doc_id all stay. Only keys are
    shuffled until it is known which go; whole rows move once, and not at all where few go.
    """
    spark, key = docs.sparkSession, ["_d", "_t"]
    ship(spark)
    with scratch(spark):
        found = stored(copies(docs))
        others = found.where("keep_id <> doc_id OR keep_t <> t").select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct()
        others = stored(others, keep=True)
        repeated = found.where("keep_id = doc_id AND keep_t = t").groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).agg(F.count("*").alias("n"))
        repeated = stored(repeated.where("n > 1").drop("n"), keep=True)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t"))
    left = without(rows, others, key)
    if not repeated.count():
        return left.select("row.*")
    one = rows.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return without(left, repeated, key).select("row.*").union(one.select("row.*"))
