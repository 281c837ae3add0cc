"""SentencePiece encoding and decoding with an Aho-Corasick automaton and Viterbi.

The automaton over all pieces reads a text once. At each place it reports, through its
output links, every piece that ends there, longest first, and each relaxes the best
score of that place; ties stay with the longest. A character that no piece covers
costs less than any piece and becomes its UTF-8 bytes.

No piece holds a word mark after another character (checked when a model is loaded),
so no piece crosses from one word to the next, and the best pieces of a text are those
of its words in a row. Words seen before come from a bounded cache.

Rows without doc_id take no part; a null text is empty and has no ids; repeated rows
are documents of their own; an empty table gives no rows. Only doc_id and text are read.
"""

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Bytes of the cache of words (an entry counts its word, its ids and ENTRY more); a full one starts anew. Longer words stay out.
CACHE, ENTRY, LONGEST = 256 << 20, 200, 64
#: Fixed value of the format: an unknown character costs this much more than the worst piece.
PENALTY = 10.0


class Codec:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.automaton, self.text, self.bytes = ahocorasick.Automaton(), [], {}
        lowest, marks_first, newline = 0.0, True, False
        for k in range(model.get_piece_size()):
            piece, score = model.id_to_piece(k), model.get_score(k)
            if model.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
                self.text.append(bytes([int(piece[3:5], 16)]))
                continue
            if model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
                self.text.append(b" \xe2\x81\x87 " if model.is_unknown(k) else b"")
                continue
            self.text.append(piece.replace(MARK, " ").encode())
            self.automaton.add_word(piece, (len(piece), score, k))
            lowest = min(lowest, score)
            marks_first &= MARK not in piece.lstrip(MARK)
            newline |= "\n" in piece
        self.automaton.make_automaton()
        self.unknown_id, self.unknown = model.unk_id(), lowest - PENALTY
        if not marks_first:
            raise ValueError("pieces of this model cross words")
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if newline else f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best pieces of a text whose blanks are marks already."""
        n = len(text)
        best, back = [0.0] + [None] * n, [None] * (n + 1)
        alone = False  # whether a piece of one character ends at the current place
        here = 0
        for end, (length, score, k) in self.automaton.iter(text):
            end += 1
            if end != here:
                if here and not alone:
                    self._unknown(best, back, here)
                for p in range(here + 1, end):
                    self._unknown(best, back, p)
                here, alone = end, False
            value = best[end - length] + score
            if best[end] is None or value > best[end]:
                best[end], back[end] = value, (length, k)
            alone |= length == 1
        if here and not alone:
            self._unknown(best, back, here)
        for p in range(here + 1, n + 1):
            self._unknown(best, back, p)
        ids: list[int] = []
        while n:
            length, k = back[n]
            if k is None:
                data = text[n - 1].encode("utf-8", "surrogatepass")
                ids.extend([self.bytes.get(b, self.unknown_id) for b in reversed(data)] if self.bytes else [self.unknown_id])
            else:
                ids.append(k)
            n -= length
        return ids[::-1]

    def _unknown(self, best: list, back: list, p: int) -> None:
        value = best[p - 1] + self.unknown
        if best[p] is None or value > best[p]:
            best[p], back[p] = value, (1, None)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = self.words.findall(MARK + text.replace(" ", MARK))
        found = list(map(self.cache.get, parts))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._word(parts[i])
        return b"".join(found)

    def _word(self, word: str) -> bytes:
        ids = array("I", self.viterbi(word)).tobytes()
        if len(word) <= LONGEST:
            if self.cached >= CACHE:
                self.cache.clear()
                self.cached = 0
            self.cache[word] = ids
            self.cached += 4 * len(word) + len(ids) + ENTRY
        return ids

    def decode(self, ids: bytes) -> str:
        """The text without the blank that encoding puts first; broken UTF-8 becomes U+FFFD."""
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per worker process and file."""
    return Codec(path)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (binary, unsigned 32-bit little-endian) of each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.encode(t.as_py()) for t in batch.column(1)], pa.binary())], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(kernel, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of ``encode_documents``."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.decode(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(kernel, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_chars, decoded_sha256 and same (decoded equals the text) in one pass."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model)
        for batch in batches:
            out = []
            for item in batch.column(1):
                text = item.as_py()
                ids = tool.encode(text)
                back = tool.decode(ids)
                out.append((len(ids) // 4, zlib.crc32(ids), len(back), sha256(back.encode()).hexdigest(), back == text))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names=["doc_id", "n_ids", "ids_crc32", "decoded_chars", "decoded_sha256", "same"])

    return _rows(docs).mapInArrow(kernel, "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_sha256 string, same boolean")
