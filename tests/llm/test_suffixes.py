"""Suffix arrays, common prefixes, and repeated bytes against brute force."""

import random
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from wardlight.llm import suffix_dedup, suffixes
from wardlight.llm.queries import QUERIES


def plain(rows, window):
    """``rows``: (doc_id, text)."""
    count = Counter()
    data = [(d, (t or "").encode()) for d, t in rows]
    for _, x in data:
        count.update(x[i:i + window] for i in range(len(x) - window + 1))
    out = []
    for d, x in data:
        gone = np.zeros(len(x) + 2, bool)
        for i in range(len(x) - window + 1):
            if count[x[i:i + window]] > 1:
                gone[i + 1:i + 1 + window] = True
        kept = bytes(b for b, g in zip(x, gone[1:], strict=False) if not g)
        out.append((d, len(x), len(x) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), sha256(kept).hexdigest()))
    return Counter(out)


def test_order_and_common_prefixes():
    r = random.Random(3)
    for _ in range(150):
        letters = r.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        runs = [bytes(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(r.randint(1, 8))]
        runs += [runs[0]] * r.randint(0, 3)
        text = suffixes.Text.of(np.frombuffer(b"".join(runs), np.uint8), np.array(list(map(len, runs)), np.int64))
        order, rank = suffixes.suffix_array(text)
        marked = [x for i, run in enumerate(runs) for x in [*((1, c) for c in run), (0, i)]]
        want = sorted(range(len(marked)), key=lambda i: marked[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(want)))
        common = suffixes.common_prefixes(text, order, rank)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while marked[a + n] == marked[b + n]:
                n += 1
            assert common[b] == n


def _texts(r, window):
    """Passages with different and equal surroundings, copies, periods, and texts of up to a window."""
    word = lambda n: "".join(r.choice("abcdefghé ") for _ in range(n))
    passages = [word(window + k * 13) for k in range(4)]
    rows = [word(r.randint(0, 2 * window)) + r.choice(passages) + word(r.randint(0, window)) for _ in range(60)]
    rows += [rows[0]] * 3 + [passages[0][k:] + word(30) for k in range(0, 40, 5)]
    base = list(word(6 * window))
    for k in range(8):
        base[k * window // 2] = chr(65 + k)
        rows.append("".join(base))
    rows += ["x " * window, "x " * (window // 2), "ab" * 3 * window, "q" * window, "q" * (window - 1), None, "", word(20 * window)]
    return [(k if k % 9 else None, t) for k, t in enumerate(rows)] + [(1, rows[1]), (1, rows[1])]


@pytest.mark.parametrize("sizes", [suffix_dedup.Sizes(), suffix_dedup.Sizes(900, 2, 500), suffix_dedup.Sizes(3000, 1, 1 << 20)])
def test_equals_brute_force(spark, sizes):
    """Also with anchors dealt to many shards, their lists to ranges, and texts cut to pieces."""
    window, gram = 60, 12
    rows = _texts(random.Random(sizes.shard), window)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffix_dedup.without_repeats(docs, window, gram, sizes, texts=False).collect()
    assert Counter(map(tuple, got)) == plain(rows, window)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = suffix_dedup.without_repeats(odd)
    assert Counter(map(tuple, out.drop("kept").collect())) == plain(rows, 400)
    assert sum(r.n_bytes - len(r.kept) for r in out.collect()) == sum(r.n_removed for r in out.collect())
    assert suffix_dedup.without_repeats(none).collect() == []


def test_registered_query_equals_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = Counter(map(tuple, QUERIES["op11_suffix_array_dedup"](spark, folder).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got == plain(rows, 400) == Counter(con.execute(suffix_dedup.ORACLE).fetchall())
