"""Best-fit packing of token sequences by exact complements.

Documents become pieces of at most ``size`` ids. Packing needs only the number of
pieces of each length, a table of at most ``size`` rows whatever the input, so the
plan is made once from that table: for each length, longest first, take the single,
pair or triple of shorter lengths whose sum exactly fills the gap, as often as the
counts allow; pieces left over go best fit. A plan line is a list of lengths and how
many sequences look like that. A piece finds its sequence by its rank among the
pieces of its length. Ranks are local rank plus the counts of earlier writers, so no
task holds all pieces of a length.

Rows without doc_id take no part; a null or empty text is one piece with the end id;
repeated rows are documents of their own; an empty table gives no rows. Only doc_id
and text are read.
"""

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import BROADCAST_BYTES, broadcast_if
from ..session import ship, stored
from .tokens import encoder

SIZE = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, writer long, local long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class _Sums:
    """Index of the lengths, and of the sums of two of them: for each sum its pairs, the larger member descending.

    A triple is a length and a pair of the rest. What is taken must be there: the counts are asked at each use.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.lengths = np.flatnonzero(counts)[::-1]
        many = np.zeros(len(counts) + 1, np.int64)
        for sums in self._sums():
            many[sums + 1] += 1
        self.starts = np.cumsum(many)
        self.larger = np.empty(self.starts[-1], np.min_scalar_type(len(counts)))  # at most size ** 2 / 4 numbers of two bytes
        free = self.starts[:-1].copy()
        for a, sums in zip(self.lengths.tolist(), self._sums(), strict=True):
            self.larger[free[sums]] = a
            free[sums] += 1

    def _sums(self) -> Iterator[np.ndarray]:
        """Sums of each length, from the largest, with itself and all smaller ones."""
        for k, a in enumerate(self.lengths.tolist()):
            sums = self.lengths[k:] + a
            yield sums[sums < len(self.counts)]

    def take(self, first: int, gap: int, most: int) -> list[int] | None:
        """At most ``most`` (up to 3) lengths that fill the gap exactly beside one piece of ``first``."""
        left = self.counts
        left[first] -= 1
        try:
            if left[gap] > 0:
                return [gap]
            found = self._pair(gap, gap) if most > 1 else None
            if found or most < 3:
                return found
            for a in self.lengths[np.searchsorted(-self.lengths, -gap, "right"):].tolist():
                if 3 * a < gap:
                    break
                if left[a] > 0:
                    left[a] -= 1
                    found = self._pair(gap - a, a)
                    left[a] += 1
                    if found:
                        return [a, *found]
            return None
        finally:
            left[first] += 1

    def _pair(self, total: int, limit: int) -> list[int] | None:
        """Two lengths of up to ``limit`` with that sum, the larger one as large as can be."""
        entries = self.larger[self.starts[total]:self.starts[total + 1]].astype(np.int64)
        entries = entries[np.searchsorted(-entries, -limit, "left"):]
        there = np.flatnonzero((self.counts[entries] > 0) & (self.counts[total - entries] > (2 * entries == total)))
        return [int(entries[there[0]]), int(total - entries[there[0]])] if len(there) else None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Plan lines (lengths of a sequence, number of such sequences) for all pieces.

    Each exact line is used as often as its counts allow, so the number of lines
    depends on the number of lengths and not on the number of pieces. Taking large
    fillings can leave gaps that small pieces would have closed, so plans with at most
    three, two and one fillers are made and the one with fewest sequences is kept.
    """
    least = -(-sum(k * n for k, n in counts.items()) // size)
    best, fewest = [], None
    index = _Sums(_array(counts, size))
    for most in (3, 2, 1):
        lines = _plan(counts, size, most, index)
        total = sum(n for _, n in lines)
        if fewest is None or total < fewest:
            best, fewest = lines, total
        if fewest == least:
            break
    return best


def _array(counts: dict[int, int], size: int) -> np.ndarray:
    found = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        found[length] += n
    return found


def _plan(counts: dict[int, int], size: int, most: int, sums: _Sums) -> list[tuple[tuple[int, ...], int]]:
    left = sums.counts = _array(counts, size)
    lines: list[tuple[tuple[int, ...], int]] = []
    residue: list[tuple[int, int]] = []
    for length in range(size, 0, -1):
        while left[length] > 0:
            fill = [] if length == size else sums.take(length, size - length, most)
            if fill is None:
                residue.append((length, int(left[length])))
                left[length] = 0
                break
            used = defaultdict(int)
            for x in (length, *fill):
                used[x] += 1
            times = int(min(left[x] // n for x, n in used.items()))
            for x, n in used.items():
                left[x] -= n * times
            lines.append(((length, *fill), times))
    return lines + _best_fit(residue, size)


def _best_fit(residue: list[tuple[int, int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over classes of equal open sequences: (lengths, gap) and how many."""
    by_gap: dict[int, list[list]] = defaultdict(list)
    gaps = np.zeros(size + 1, bool)
    for length, n in residue:
        while n:
            fits = np.flatnonzero(gaps[length:])
            if not len(fits):
                per = min(size // length, n)
                for k, times in ((per, n // per), (n % per, int(n % per > 0))):
                    if times:
                        by_gap[size - k * length].append([(length,) * k, times])
                        gaps[size - k * length] = True
                break
            gap = int(fits[0]) + length
            lengths, times = by_gap[gap].pop()
            gaps[gap] = bool(by_gap[gap])
            k = min(gap // length, n)  # pieces of this length that one such sequence takes
            took = min(times, n // k)
            n -= took * k
            if times > took:
                by_gap[gap].append([lengths, times - took])
                gaps[gap] = True
            rest = gap - k * length
            by_gap[rest].append([lengths + (length,) * k, took])
            gaps[rest] = True
    return [(tuple(lengths), times) for group in by_gap.values() for lengths, times in group]


def slots(lines: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: where pieces of a length go by rank."""
    rows, next_rank, sequence = [], defaultdict(int), 0
    for lengths, times in lines:
        offset = 0
        for x in lengths:
            rows.append((x, next_rank[x], sequence, offset))
            next_rank[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Pieces of each document with their rank among this task's pieces of equal length; written once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, writer, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = tool.encode(text.as_py()) + end
                for k in range(0, len(data) // 4, size):
                    part = data[4 * k:4 * (k + size)]
                    n = len(part) // 4
                    out.append((doc_id, k // size, k, n, zlib.crc32(part), writer, seen[n]))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES) if out else _EMPTY

    return stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").mapInArrow(cut, PIECES))


_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "writer", "local"]
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
_EMPTY = pa.RecordBatch.from_arrays([pa.array([], t) for t in _TYPES], names=_NAMES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    ship(spark)
    cut = pieces(docs, tokenizer, end_id, size)
    counts = stored(cut.groupBy("length", "writer").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``size`` rows
    table = spark.sparkContext.broadcast(slots(plan(histogram, size)))
    earlier = Window.partitionBy("length").orderBy("writer").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(counts.select("length", "writer", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), keep=True)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            sequence = rows[at, 2] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(rows[at, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    # a key has at most the pieces of one writer; a small table is broadcast by its counted rows, another one merged
    n = before.count()
    near = broadcast_if(before, n, 64) if n * 64 <= BROADCAST_BYTES else before.hint("merge")
    ranked = cut.join(near, ["length", "writer"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, PACKED)
