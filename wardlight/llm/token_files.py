"""Token-ID output: files of ids in the fewest bits that hold the vocabulary.

A file holds blocks of ``BLOCK`` ids. An id takes ``width`` bits, least bit first,
ids follow each other without gaps and each block begins on a byte. After the
blocks come doc_ids, document starts (one more than documents) and block offsets,
each as little-endian signed 64-bit integers, then a fixed trailer. A reader gets
the trailer and the offsets with two range reads and then unpacks only the blocks
it needs with numpy.

Rows without doc_id take no part; a null text is an empty one; repeated rows are
documents of their own; an empty table gives no rows. Only doc_id and text are read.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .files import create, new_folder, one_task_each, open_range
from .tokens import encoder

MAGIC = b"IDBITS01"
BLOCK = 4096
#: width, ids of a block, ids, documents, place of the doc_ids; then the magic again.
TRAILER = struct.Struct("<IIQQQ8s")
#: Ids that a writer or reader holds at once.
CHUNK = 1 << 20


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype="<u4")) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return bits @ (np.uint32(1) << np.arange(width, dtype="<u4"))


class Writer:
    """Takes documents one by one; holds one block and 16 bytes a document."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.place = 0
        self.doc_ids: list[int] = []
        self.starts: list[int] = [0]
        self.blocks: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.place += len(data)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.n_ids += len(ids)
        self.starts.append(self.n_ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= CHUNK:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        for k in range(0, whole, BLOCK):
            self.blocks.append(self.place)
            self._put(pack(ids[k:min(k + BLOCK, whole)], self.width))
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(last=True)
        at = self.place
        for x in (self.doc_ids, self.starts, self.blocks):
            self._put(np.array(x, "<i8").tobytes())
        self._put(TRAILER.pack(self.width, BLOCK, self.n_ids, len(self.doc_ids), at, MAGIC))


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - TRAILER.size)
        self.width, self.block, self.n_ids, n_docs, at, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        source.seek(at)
        numbers = np.frombuffer(source.read(size - TRAILER.size - at), "<i8")
        self.doc_ids, self.starts, self.blocks = np.split(numbers, [n_docs, 2 * n_docs + 1])
        self.ends = np.append(self.blocks[1:], at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, read from the blocks that hold them."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.blocks[first]))
        data = self.source.read(int(self.ends[last] - self.blocks[first]))
        found = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_ids - k * self.block)
            a = int(self.blocks[k] - self.blocks[first])
            found.append(unpack(data[a:a + (n * self.width + 7) // 8], self.width, n))
        return np.concatenate(found)[start - first * self.block:stop - first * self.block]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write one file a partition in ascending doc_id order.

    Returns the table of committed files: part, uri, n_ids, base (ids in earlier files).
    A repeated task writes a new file; only files in the table count.
    """
    folder = new_folder(docs.sparkSession, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, uri, writer, out = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.ids", None, None
        tool = encoder(tokenizer)
        end = np.array([end_id], "<u4")
        for batch in batches:
            if writer is None:
                out = create(uri)
                writer = Writer(out, width_of(max(tool.vocabulary, end_id + 1)))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(doc_id, np.concatenate([np.frombuffer(tool.encode(text.as_py()), "<u4"), end]))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "uri": [uri], "n_ids": pa.array([writer.n_ids], pa.int64())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = stored(ordered.mapInArrow(write, "part long, uri string, n_ids long"))
    # one row a file, so this one window stays small
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_range(row["uri"]) as source:
                    reader = Reader(source)
                    starts, first = reader.starts, 0
                    while first < len(reader.doc_ids):
                        last = max(first + 1, int(np.searchsorted(starts, starts[first] + CHUNK, "right")) - 1)
                        data = reader.ids(int(starts[first]), int(starts[last])).astype("<u4").tobytes()
                        at = (4 * (starts[first:last + 1] - starts[first])).tolist()
                        view = memoryview(data)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.doc_ids[first:last]), pa.array(starts[first:last] + row["base"]), pa.array(np.diff(starts[first:last + 1])),
                            pa.array([zlib.crc32(view[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    return one_task_each(files.select("uri", "base")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
