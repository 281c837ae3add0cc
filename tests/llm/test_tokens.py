"""Token files and packing: the library's own ids, exact round trips, gapless packing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from wardlight.llm import packing, token_files
from wardlight.llm.tokens import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def library(text):
    return np.array([*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_encoder_equals_library():
    r, tool = random.Random(2), encoder(PATH)
    texts = ["", "  ", "it's 'tis don't'' !'s ²³ ½a ª", "ÀÉ ÿŸ ſt İx Σς", "a<|endoftext|>b <|startoftext|>", "\x0b\x1c\x85\xa0y é"]
    texts += ["".join(r.choice("ab'sStTreRE 12²!?.,ñÑſŸµß\t\n×´¨梦😀") for _ in range(60)) for _ in range(500)]
    assert [t for t in texts if tool.encode(t) != tool.whole(t)] == []


@pytest.mark.parametrize("width", [1, 5, 12, 16, 17, 31, 32])
def test_packed_file_round_trip(width):
    r = np.random.default_rng(width)
    docs = [r.integers(0, 2 ** width, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 5000, 3, 0, 9000, 4096)]
    out = pa.BufferOutputStream()
    writer = token_files.Writer(out, width)
    for k, ids in enumerate(docs):
        writer.add(k, ids)
    writer.close()
    reader = token_files.Reader(pa.BufferReader(out.getvalue()))
    for k, ids in enumerate(docs):
        assert reader.ids(int(reader.starts[k]), int(reader.starts[k + 1])).tolist() == ids.tolist()
    every = np.concatenate(docs)
    assert reader.ids(4000, 9001).tolist() == every[4000:9001].tolist()
    assert out.getvalue().size < 40 + len(every) * width / 8 + 8 * (2 * len(docs) + 2 + len(reader.blocks)) + 16


def test_width_is_least():
    assert [token_files.width_of(n) for n in (1, 2, 3, 4, 5, 49408, 65536, 65537)] == [1, 1, 2, 2, 3, 16, 16, 17]


def test_token_files(odd, none):
    rows = [tuple(r) for r in token_files.read_token_files(token_files.write_token_files(odd, PATH)).collect()]
    want = sorted((r.doc_id, library(r.text).tobytes()) for r in odd.collect() if r.doc_id is not None)
    assert sorted((r[0], r[2], r[3]) for r in rows) == sorted((d, len(x) // 4, zlib.crc32(x)) for d, x in want)
    place = 0
    for d, start, n, _ in sorted(rows, key=lambda x: (x[1], x[2])):
        assert start == place
        place += n
    assert [r[0] for r in sorted(rows, key=lambda x: x[1])] == sorted(r[0] for r in rows)
    assert token_files.read_token_files(token_files.write_token_files(none, PATH)).collect() == []


@pytest.mark.parametrize("kind", range(4))
def test_plan_is_gapless_and_close_to_least(kind):
    r = np.random.default_rng(kind)
    lengths = [np.clip(np.exp(r.normal(6.2, 1.1, 30000)).astype(int), 1, 4096), r.integers(1, 4097, 3000), np.full(5000, 1365), np.array([4096, 1, 4095, 2048, 2048, 1024, 3072])][kind]
    counts = Counter(lengths.tolist())
    lines = packing.plan(counts)
    used = Counter()
    for parts, n in lines:
        assert sum(parts) <= 4096
        for x in parts:
            used[x] += n
    assert used == counts
    least = max(-(-int(lengths.sum()) // 4096), 0)
    assert sum(n for _, n in lines) <= least * 1.03 + 1


def test_exact_single_pair_and_triple():
    assert packing.plan({4000: 1, 96: 1}) == [((4000, 96), 1)]
    assert sum(n for _, n in packing.plan({4000: 5, 60: 5, 36: 5})) == 5
    assert sum(n for _, n in packing.plan({3000: 2, 500: 2, 400: 2, 196: 2})) == 2


def test_pack_documents(odd, none):
    rows = packing.pack_documents(odd, PATH).collect()
    want = defaultdict(int)
    for r in odd.collect():
        if r.doc_id is not None:
            ids = library(r.text)
            for k in range(0, len(ids), 4096):
                part = ids[k:k + 4096].tobytes()
                want[r.doc_id, k // 4096, k, len(part) // 4, zlib.crc32(part)] += 1
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == want
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda x: (x.sequence_id, x.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(ends.values()) // 4096)
    assert packing.pack_documents(none, PATH).collect() == []


def test_caches_of_a_worker_are_small():
    """Both together; four workers of an executor hold them beside its heap."""
    from wardlight.llm import tokens

    assert 2 * tokens.CACHE <= 100 << 20
