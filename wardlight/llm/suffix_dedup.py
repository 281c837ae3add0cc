"""Removal of repeated byte strings with suffix arrays.

A byte goes if a window of ``window`` bytes covers it that also starts anywhere else, in
the same text or another; every occurrence goes, also the first. Windows lie within one
text and are judged on the input.

1. Every window has an anchor: the least hash of its ``gram``-byte strings, the leftmost of
   equal ones. Windows of one anchor place form a run of at most ``2 * window - gram`` bytes.
   Equal windows have equal anchors at equal distances, so only runs whose anchor occurs
   twice or more can hold repeated windows. Where all runs of an anchor are equal (by
   128-bit hashes), all their windows repeat; these need no comparison.
2. The distinct runs of all other anchors are cut out of one text each and dealt to shards
   of ``SHARD`` bytes. A shard builds the suffix array of its runs by Larsson-Sadakane
   refinement and Kasai's common prefixes: neighbours that share a window's length are
   equal windows. A run that occurs twice or more repeats as a whole and is a reference only.
3. An anchor with more runs than a shard holds is dealt to several. Each gives the windows
   that it holds, one of each kind, as sorted lists by distance from the anchor, which are
   cut into ranges by binary search; lists of one range meet, and each is searched in the
   merged ones before it.
4. Each text marks the windows found and leaves out what they cover.

Results are exact up to collisions of 128-bit hashes, for any setting of the sizes. A null text is empty. Rows that
repeat are texts of their own. A null doc_id is a doc_id like any other. An empty
table gives no rows. Other columns than doc_id and text are not read.
"""

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch, ship, stored
from .columns import lookup
from .suffixes import Text, common_prefixes, suffix_array
from .windows import mix, parts

WINDOW, GRAM = 400, 64
#: Bytes of a text that are worked on at once.
PIECE = 1 << 20
#: Runs, and bytes of texts, that leave a task at once.
RUNS, LEAVE = 4096, 1 << 22


class Sizes(NamedTuple):
    """Bytes of runs in a shard (its arrays take about 100 times that), shards of an anchor whose lists meet in one task, bytes of a text worked on at once."""

    shard: int = 1 << 20
    lists: int = 64
    piece: int = PIECE


_U = np.uint64
_PLACE = _U((1 << 24) - 1)
_BASES = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)
_INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASES)
_BYTES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * b) for b in _BASES)
_KIND = "anchor long, h1 long, h2 long"
#: A window in a sorted list: its hashes, and where it is asked for the hashes of its run and its number there.
_ENTRY = np.dtype([("window", "S16"), ("h1", "<i8"), ("h2", "<i8"), ("at", "<i4"), ("asked", "u1")])


class _Powers:
    """Powers of both bases and of their inverses modulo 2^64, as many as were needed so far."""

    up = down = [np.ones(1, np.uint64)] * 2

    @classmethod
    def of(cls, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        if len(cls.up[0]) < n:
            size = max(n, PIECE + WINDOW)
            cls.up, cls.down = ([np.cumprod(np.append(_U(1), np.full(size - 1, b, np.uint64))) for b in bases] for bases in (_BASES, _INVERSES))
        return [x[:n] for x in cls.up], [x[:n] for x in cls.down]


class Hashes:
    """Hashes of any stretches of some bytes, by sums over the bytes before."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _Powers.of(len(data) + 1)
        self.sums = [np.append(_U(0), np.cumsum(table[data] * up[:-1])) for table, up in zip(_BYTES, self.up, strict=True)]

    def of(self, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        s = self.sums[which]
        return mix((s[ends] - s[starts]) * self.down[which][starts])


def _runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """First and end window, distance of the anchor, its hash, and two hashes of each run; ``offsets`` part the texts."""
    count = len(data) - window + 1
    if count <= 0:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + tuple(np.empty(0, np.uint64) for _ in range(3))
    hashes, place = Hashes(data), np.arange(len(data) - gram + 1)
    grams = hashes.of(place, place + gram, 0)
    least, reach, wide = grams & ~_PLACE | place.astype(np.uint64), 1, window - gram + 1
    while 2 * reach <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if wide > reach:
        least = np.minimum(least[:len(least) - (wide - reach)], least[wide - reach:])
    chosen = (least[:count] & _PLACE).astype(np.int64)
    valid = np.zeros(count + 1, np.int64)
    long = np.diff(offsets) >= window
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - window + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    edges = np.ones(count + 1, bool)
    edges[1:-1] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])
    edges[offsets[(offsets > 0) & (offsets < count)]] = True
    edges = np.flatnonzero(edges)
    first, end = edges[:-1], edges[1:]
    keep = valid[first]
    first, end = first[keep], end[keep]
    at = chosen[first]
    shape = mix(((at - first) << 32 | (end - first)).astype(np.uint64))
    return first, end, at - first, grams[at], *(hashes.of(first, end + window - 1, k) ^ shape for k in (0, 1))


def _pieces(column: pa.Array, window: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, places in their texts, bytes and offsets of pieces of texts; pieces of one text overlap by a window less one."""
    for a, b, data, offsets in parts(column, size):
        if len(data) <= size or b - a > 1:
            yield np.arange(a, b), np.zeros(b - a, np.int64), data, offsets
            continue
        for k in range(0, len(data), size):
            piece = data[k:k + size + window - 1]
            yield np.array([a]), np.array([k]), piece, np.array([0, len(piece)])


def _run_rows(rows: DataFrame, window: int, gram: int, piece: int) -> DataFrame:
    """doc_id, t, anchor, h1, h2, first (window), n (windows) and off (places from the first window to its anchor) of each run."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, place, data, offsets in _pieces(batch.column(2), window, piece):
                first, end, off, *hashes = _runs(data, offsets, window, gram)
                text = np.searchsorted(offsets, first, "right") - 1
                owner = pa.array(row[text])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(owner), batch.column(1).take(owner), *[pa.array(h.view(np.int64)) for h in hashes],
                     pa.array(first - offsets[text] + place[text]), pa.array((end - first).astype(np.int32)), pa.array(off.astype(np.int32))], names=["doc_id", "t", "anchor", "h1", "h2", "first", "n", "off"])

    return rows.mapInArrow(kernel, f"doc_id long, t long, {_KIND}, first long, n int, off int")


def _cut_rows(rows: DataFrame, window: int) -> DataFrame:
    """anchor, h1, h2, many, off and run (its bytes) of the runs that a text (doc_id, t, text, wanted) stands for."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            edges, items = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).tolist(), lists.flatten()
            first, n = items.field("first").to_pylist(), items.field("n").to_pylist()
            a = runs_from = 0
            runs: list[bytes] = []
            for text, b in zip(batch.column("text"), edges[1:], strict=True):
                raw = memoryview(text.as_buffer())
                runs += [bytes(raw[x:x + k + window - 1]) for x, k in zip(first[a:b], n[a:b], strict=True)]
                a = b
                if len(runs) >= RUNS or b == edges[-1]:
                    yield pa.RecordBatch.from_arrays([*[items.field(c).slice(runs_from, len(runs)) for c in names], pa.array(runs, pa.binary())], names=[*names, "run"])
                    runs_from, runs = b, []

    names = ["anchor", "h1", "h2", "many", "off"]
    return rows.select("text", "wanted").mapInArrow(kernel, f"{_KIND}, many long, off int, run binary")


def _spans(flags: np.ndarray, starts: np.ndarray) -> list[list[dict]]:
    """For each run the stretches (at, n) of marked places; runs begin at ``starts``, and their last place is never marked."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.searchsorted(starts, first, "right") - 1
    out: list[list[dict]] = [[] for _ in starts]
    for r, a, b in zip(run.tolist(), (first - starts[run]).tolist(), (end - first).tolist(), strict=True):
        out[r].append({"at": a, "n": b})
    return out


_SPAN_LIST = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))


def _shard(columns: dict[str, list], window: int, lists: int) -> pa.RecordBatch:
    """Rows of one shard: spans of repeated windows of the runs that occur once, and sorted lists of windows of anchors that other shards share."""
    lengths = np.array(list(map(len, columns["run"])), np.int64)
    data = np.frombuffer(b"".join(columns["run"]), np.uint8)
    text = Text.of(data, lengths)
    order, rank = suffix_array(text)
    common = common_prefixes(text, order, rank)
    equal = np.append(common[order[1:]] >= window, False)  # to the next in order
    repeated = np.zeros(len(order), bool)
    repeated[order[equal]] = repeated[order[1:][equal[:-1]]] = True
    spans = _spans(repeated, text.starts)
    out = [(a, h1, h2, x, None, None, None) for a, h1, h2, many, x in zip(columns["anchor"], columns["h1"], columns["h2"], columns["many"], spans, strict=True) if many == 1 and x]
    shared = np.array([p > 1 for p in columns["parts"]])
    if shared.any():
        out += _lists(columns, text, data, lengths, order[np.append(True, ~equal[:-1])], repeated, shared, window, lists)
    types = [pa.int64(), pa.int64(), pa.int64(), _SPAN_LIST, pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


_FOUND = f"{_KIND}, spans array<struct<at:bigint,n:bigint>>, off int, piece long, windows binary"


def _lists(columns: dict[str, list], text: Text, data: np.ndarray, lengths: np.ndarray, kinds: np.ndarray, repeated: np.ndarray, shared: np.ndarray, window: int, lists: int) -> list[tuple]:
    """Windows of shared anchors, one of each kind, sorted and cut into ranges by binary search."""
    run = np.searchsorted(text.starts, kinds, "right") - 1
    at = kinds - text.starts[run]
    some = shared[run] & (at <= lengths[run] - window)
    kinds, run, at = kinds[some], run[some], at[some]
    place, hashes = kinds - run, Hashes(data)  # places without end marks
    many, h1, h2, anchor, off, n_parts = (np.array(columns[c], np.int64) for c in ("many", "h1", "h2", "anchor", "off", "parts"))
    entries = np.zeros(len(kinds), _ENTRY)
    both = np.empty((len(kinds), 2), ">u8")
    for k in (0, 1):
        both[:, k] = hashes.of(place, place + window, k)
    entries["window"] = both.view("S16").ravel()
    entries["h1"], entries["h2"], entries["at"], entries["asked"] = h1[run], h2[run], at, (many[run] == 1) & ~repeated[kinds]
    distance = off[run] - at
    turn = np.lexsort((both[:, 1], both[:, 0], distance, anchor[run]))
    entries, anchors, distance, pieces = entries[turn], anchor[run][turn], distance[turn], -(-n_parts[run][turn] // lists)
    edges = np.flatnonzero(np.append(True, (anchors[1:] != anchors[:-1]) | (distance[1:] != distance[:-1]))) if len(entries) else np.empty(0, np.int64)
    out = []
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(entries)).tolist(), strict=True):
        n = int(pieces[a])
        bounds = np.array([(j << 128) // n for j in range(1, n)], object)
        marks = np.array([int(x).to_bytes(16, "big") for x in bounds], "S16") if n > 1 else np.empty(0, "S16")
        cuts = [a, *(a + np.searchsorted(entries["window"][a:b], marks)).tolist(), b]
        out += [(int(anchors[a]), None, None, None, int(distance[a]), j, entries[x:y].tobytes()) for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
    return out


def _shards(window: int, sizes: Sizes):
    """Kernel over runs sorted by anchor, part and hashes: shards close at their size, between parts."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        total = 0
        for batch in batches:
            columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            for k in range(batch.num_rows):
                key = columns["anchor"][k], columns["part"][k]
                if held and all(columns[c][k] == held[c][-1] for c in ("anchor", "h1", "h2")):
                    continue  # from a row that repeats another
                if total >= sizes.shard and key != (held["anchor"][-1], held["part"][-1]):
                    yield _shard(held, window, sizes.lists)
                    held, total = {}, 0
                for name, values in columns.items():
                    held.setdefault(name, []).append(values[k])
                total += len(columns["run"][k])
        if held:
            yield _shard(held, window, sizes.lists)

    return kernel


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Runs and windows that two shards or more hold: each list is searched in the merged ones before it."""
    merged, hits, out = np.empty(0, _ENTRY), np.empty(0, bool), []
    for x in table.column("windows").to_pylist():
        entries = np.frombuffer(x, _ENTRY)
        at = np.searchsorted(merged["window"], entries["window"])
        known = at < len(merged)
        known[known] = merged["window"][at[known]] == entries["window"][known]
        hits[at[known]] = True
        out.append(entries[known])
        merged, hits = np.insert(merged, at[~known], entries[~known]), np.insert(hits, at[~known], False)
    found = np.concatenate([*out, merged[hits]])
    found = found[found["asked"] == 1]
    return pa.table({"anchor": pa.array(np.full(len(found), key[0].as_py(), np.int64)), "h1": pa.array(found["h1"]), "h2": pa.array(found["h2"]), "at": pa.array(found["at"].astype(np.int64))})


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, t (hash of the text) and spans (first window, number) of windows that start anywhere else as well, of texts that have some."""
    ship(docs.sparkSession)
    kind = ["anchor", "h1", "h2"]
    with scratch(docs.sparkSession):
        texts = _texts(docs)
        runs = stored(_run_rows(texts, window, gram, sizes.piece))
        differ = (F.min("h1") != F.max("h1")) | (F.min("h2") != F.max("h2"))
        shared = stored(runs.groupBy("anchor").agg(F.count("*").alias("c"), differ.alias("mixed")).where("c > 1").select("anchor", "mixed"))
        runs = stored(runs.join(shared, "anchor"))
        whole = runs.where("NOT mixed").select("doc_id", "t", F.col("first").alias("at"), F.col("n").cast("long").alias("n"))
        mixed = runs.where("mixed").drop("mixed")
        kinds = stored(mixed.groupBy(*kind).agg(F.count("*").alias("many"), F.min(F.struct("doc_id", "t", "first", "n", "off")).alias("one")))
        wanted = kinds.groupBy("one.doc_id", "one.t").agg(F.collect_list(F.struct(*kind, "many", "one.first", "one.n", "one.off")).alias("wanted"))
        wanted = wanted.select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "wanted")
        cut = texts.join(wanted, texts.doc_id.eqNullSafe(F.col("_d")) & (texts.t == F.col("_t"))).select("text", "wanted")
        cut = stored(_cut_rows(cut, window))
        large = stored(cut.groupBy("anchor").agg(F.ceil(F.sum(F.octet_length("run")) / sizes.shard).cast("int").alias("parts")).where("parts > 1"))
        dealt = lookup(cut, large, ["anchor"], "left", F.col("h1")).withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = dealt.withColumn("part", F.pmod("h1", F.col("parts").cast("long")).cast("int"))
        found = dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "h1", "h2").mapInArrow(_shards(window, sizes), _FOUND)
        found = stored(found)
        alone = found.where("windows IS NULL").select(*kind, F.inline("spans"))
        met = found.where("windows IS NOT NULL").select("anchor", "off", "piece", "windows").groupBy("anchor", "off", "piece").applyInArrow(_merged, f"{_KIND}, at long")
        copied = kinds.where("many > 1").select(*kind, F.lit(0).cast("long").alias("at"), F.col("one.n").cast("long").alias("n"))
        answers = alone.union(met.select(*kind, "at", F.lit(1).cast("long").alias("n"))).union(copied)
        placed = mixed.select("doc_id", "t", *kind, "first").join(stored(answers), kind).select("doc_id", "t", (F.col("first") + F.col("at")).alias("at"), "n")
        return stored(whole.union(placed).groupBy("doc_id", "t").agg(F.collect_set(F.struct("at", "n")).alias("spans")), keep=True)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def _covered(n: int, spans: list[dict] | None, window: int) -> np.ndarray:
    """Edges of the maximal stretches that go: first and end places, one after the other."""
    change = np.zeros(n + 1, np.int64)
    for s in spans or ():
        change[s["at"]] += 1
        change[s["at"] + s["n"] + window - 1] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sizes: Sizes = Sizes(), texts: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (the bytes left) of each row."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            a = size = 0
            for k, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True)):
                data = bytes(memoryview(text.as_buffer()))
                edges = _covered(len(data), spans.as_py(), window).tolist() if spans.is_valid else []
                kept = b"".join(data[x:y] for x, y in zip([0, *edges[1::2]], [*edges[::2], len(data)], strict=True)) if edges else data
                rows.append((len(data), len(data) - len(kept), len(edges) // 2, sha256(kept).hexdigest(), *([kept] if texts else [])))
                size += len(kept)
                if size >= LEAVE or k == batch.num_rows - 1:
                    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(rows)), *columns], names=names)
                    a, rows, size = k + 1, [], 0

    gone = repeated_windows(docs, window, gram, sizes).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t"), "spans")
    read = _texts(docs)
    rows = read.join(gone, read.doc_id.eqNullSafe(F.col("_d")) & (read.t == F.col("_t")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(kernel, schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents),
x AS (SELECT row, doc_id, octet_length(b) AS n, hex(b) AS h FROM d),
p AS (SELECT row, n, k, substring(h, 2 * k + 1, 1798) AS part FROM (SELECT row, n, h, unnest(range(0, n - 399, 500)) AS k FROM x WHERE n >= 400)),
w AS (SELECT row, k + j AS i, md5_number(substring(part, 2 * j + 1, 800)) AS win FROM (SELECT row, k, part, unnest(range(0, least(500, n - 399 - k))) AS j FROM p)),
r AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY win) AS c FROM w) WHERE c > 1),
g AS (SELECT row, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT row, min(i) AS a, max(i) + 400 AS z FROM (SELECT row, i, sum(new) OVER (PARTITION BY row ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY row, k),
k AS (SELECT row, list(a ORDER BY a) AS first, list(z ORDER BY a) AS last FROM s GROUP BY row)
SELECT doc_id, n AS n_bytes, CAST(n - octet_length(kept) AS BIGINT) AS n_removed, CAST(coalesce(len(first), 0) AS BIGINT) AS n_spans, sha256(kept) AS kept_sha256
FROM (SELECT doc_id, n, first, unhex(CASE WHEN first IS NULL THEN h ELSE array_to_string(list_transform(list_zip(list_prepend(0, last), list_append(first, n)), lambda p: h[2 * p[1] + 1:2 * p[2]]), '') END) AS kept
  FROM x LEFT JOIN k USING (row))"""
