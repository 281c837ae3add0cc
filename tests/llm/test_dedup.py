"""Substring dedup, SimHash and top-k against brute force."""

import random
from hashlib import sha256

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from wardlight.llm import balltree, simhash, substring
from wardlight.llm.automaton import SuffixAutomaton
from wardlight.llm.components import components


def repeats(rows, n):
    """Kept words of each (doc_id, text) by comparing all windows."""
    words = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in words:
        for k in range(len(w) - n + 1):
            if d is not None:
                key = tuple(w[k:k + n])
                least[key] = min(d, least.get(key, d))
    for d, w in words:
        gone = {k + j for k in range(len(w) - n + 1) if d is not None and least[tuple(w[k:k + n])] < d for j in range(n)}
        yield d, w, [x for k, x in enumerate(w) if k not in gone]


def test_automaton_matches_brute_force():
    r = random.Random(1)
    for _ in range(300):
        texts = [[r.choice("abc") for _ in range(r.randint(1, 12))] for _ in range(r.randint(1, 6))]
        owners = [r.randint(0, 9) for _ in texts]
        tool, n = SuffixAutomaton(), r.randint(1, 4)
        for t, o in zip(texts, owners, strict=True):
            tool.add(t, o)
        tool.settle()
        query = [r.choice("abcd") for _ in range(15)]
        want = []
        for k in range(len(query)):
            part = query[k - n + 1:k + 1] if k + 1 >= n else None
            has = [o for t, o in zip(texts, owners, strict=True) if part and any(t[i:i + n] == part for i in range(len(t)))]
            want.append(min(has) if has else None)
        assert tool.matches(query, n) == want


@pytest.mark.parametrize("crowded", [1024, 0])
def test_substring_digests(odd, none, monkeypatch, crowded):
    monkeypatch.setattr(substring, "CROWDED", crowded)
    monkeypatch.setattr(substring, "SHARD", 50)
    want = sorted((str(d), len(w), len(w) - len(k), sha256(b" ".join(k)).hexdigest()) for d, w, k in repeats([(r.doc_id, r.text) for r in odd.collect()], 13))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(odd).collect())
    assert got == want and sum(x[2] for x in want) > 300
    assert substring.digests(none).collect() == []


def test_substring_small_alphabet(spark):
    r = random.Random(3)
    rows = [(r.randint(0, 30), " ".join(r.choice("abcde") for _ in range(r.randint(0, 40)))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for window, gram in ((4, 2), (5, 5), (3, 1)):
        want = sorted((d, len(w), sha256(b" ".join(k)).hexdigest()) for d, w, k in repeats(rows, window))
        assert sorted((x.doc_id, x.n_words, x.kept_sha256) for x in substring.digests(docs, window, gram).collect()) == want


def test_cut_texts_keep_columns_and_white_space(odd):
    cut = substring.without_repeats(odd)
    assert cut.columns == odd.columns and [f.dataType for f in cut.schema] == [f.dataType for f in odd.schema]
    want = sorted((str(d), b" ".join(k)) for d, _, k in repeats([(r.doc_id, r.text) for r in odd.collect()], 13))
    rows = cut.collect()
    assert sorted((str(r.doc_id), b" ".join(r.text.encode().split())) for r in rows) == want
    assert [r.text for r in rows if r.doc_id == 14] == [r.text for r in odd.collect() if r.doc_id == 14]
    assert all(r.n_chars == len(r.text) for r in rows) and {r.host for r in rows} == {"h", None}


def plain_print(text, n=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k:k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = list(range(len(nodes)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(nodes)):
        for b in range(a):
            if linked(nodes[a], nodes[b]):
                root[find(a)] = find(b)
    return [find(k) for k in range(len(nodes))]


def expected(rows):
    """(doc_id, print, least doc_id reached) by comparing all pairs."""
    nodes = [(d, plain_print(t)) for d, t in rows if d is not None]
    group = plain_components(nodes, lambda a, b: a[0] == b[0] or (a[1] ^ b[1]).bit_count() <= 3)
    least = {}
    for (d, _), g in zip(nodes, group, strict=True):
        least[g] = min(d, least.get(g, d))
    return sorted((d, p, least[g]) for (d, p), g in zip(nodes, group, strict=True))


def test_near_duplicates(odd, none):
    got = sorted((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.near_duplicates(odd).collect())
    assert got == expected([(r.doc_id, r.text) for r in odd.collect()])
    assert simhash.near_duplicates(none).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted((r.doc_id, r.fp % 2 ** 64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("chunk", [2048, 7])
def test_dense_prints_are_all_linked(spark, monkeypatch, chunk):
    """Many prints around one centre, and chains; small chunks deal the keys to pairs of tasks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "LINKS", 50)
    r = random.Random(chunk)
    centre, prints = r.getrandbits(64), set()
    for _ in range(150):
        prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))))
    chain = r.getrandbits(64)
    for k in range(0, 60, 3):
        chain ^= 7 << k
        prints.add(chain)
    prints |= {r.getrandbits(64) for _ in range(100)} | {0, 7, 15, (1 << 64) - 1}
    nodes = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 1000 + k) for k, p in enumerate(nodes)], "fp long, doc long")
    roots = {x.node: x.root for x in components(simhash.links(table)).collect()}
    group = plain_components(nodes, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(1000 + k, least.get(g, 1000 + k))
    assert [roots.get(1000 + k, 1000 + k) for k in range(len(nodes))] == [least[g] for g in group]


def test_masks_cover_all_near_pairs():
    r = random.Random(8)
    for blocks, distance in ((6, 3), (4, 3), (7, 5), (5, 2)):
        keys = simhash.masks(blocks, distance)
        for _ in range(300):
            flip = sum(1 << b for b in r.sample(range(64), distance))
            assert any(m & flip == 0 for m in keys)


def test_one_of_each_keeps_columns(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2  # rows without doc_id stay
    assert 4 in ids and 5 not in ids and 6 not in ids and ids.count(4) == 1
    assert set(range(100, 140)) <= set(ids) and {9, 14} <= set(ids)
    assert simhash.one_of_each(none).collect() == []


def test_near_copies_and_clean_documents(spark):
    """Copies with few changed words lose all but one; different texts in the same words stay."""
    r = random.Random(11)
    words = ["".join(r.choice("aeioustrnl") for _ in range(r.randint(2, 7))) for _ in range(400)]
    common = words[:40]
    text = lambda n: [r.choice(common) if r.random() < 0.6 else r.choice(words) for _ in range(n)]
    rows, near = [], []
    for k in range(60):
        rows.append((k, " ".join(text(r.choice([60, 300, 3000])))))
    for k in range(20):
        base = text(400)
        rows.append((100 + k, " ".join(base)))
        for j in range(3):
            copy = list(base)
            for p in r.sample(range(400), 6):
                copy[p] = "new" + str(p)
            rows.append((1000 + 10 * k + j, " ".join(copy)))
            near.append(1000 + 10 * k + j)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {x.doc_id for x in simhash.one_of_each(docs).collect()}
    assert {d for d, _ in rows if d < 1000} <= ids
    assert len(ids & set(near)) <= 0.1 * len(near)


def brute_top(vectors, queries, k=5):
    out = []
    for q, v in queries:
        rows = sorted(((-int(np.dot(v, x)), c) for c, x in vectors if c != q and len(x) == len(v)))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(rows)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(balltree, "SHARD_ROWS", 40)
    monkeypatch.setattr(balltree, "BLOCK_ROWS", 3)
    r = np.random.default_rng(6)
    vectors = [(k, r.integers(-20, 20, 6).tolist()) for k in range(200)] + [(300 + k, [1] * 6) for k in range(30)] + [(400 + k, [2, 3]) for k in range(3)] + [(7, [9] * 6)]
    queries = [x for x in vectors if x[0] % 10 == 0]
    table = spark.createDataFrame(vectors, "vec_id long, vector array<long>")
    asked = table.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted(tuple(x) for x in balltree.top_k(table, asked).collect())
    assert got == brute_top(vectors, queries)
    assert balltree.top_k(table.where("false"), asked.where("false")).collect() == []


@pytest.mark.parametrize("most", [30, 2 ** 29])
def test_search_is_exact_with_ties_and_large_numbers(most):
    r = np.random.default_rng(most)
    vectors, queries = r.integers(-most, most, (500, 8)), r.integers(-most, most, (20, 8))
    vectors[100:200] = vectors[:100]
    ids = r.permutation(500)
    tree = balltree.BallTree(ids, vectors, leaf=16)
    got = balltree.Search(tree, np.arange(1000, 1020), queries, 5)
    for k in range(20):
        want = sorted((-int(a @ queries[k].astype(object)), int(i)) for a, i in zip(vectors.astype(object), ids, strict=True))[:5]
        assert list(zip((-got.scores[k]).tolist(), got.found[k].tolist(), strict=True)) == want


def test_usable_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [-0.001, 0.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = table.where(balltree.usable("embedding")).select("vec_id", balltree.whole_numbers("embedding").alias("v")).collect()
    assert [(x.vec_id, x.v) for x in got] == [(1, [256, 512]), (7, [-1, 128])]


def shingles(text):
    words = text.encode().split()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def made_words(r, n):
    return ["".join(r.choice("aeioustrnl") for _ in range(7)) for _ in range(n)]


def test_links_below_the_similarity_are_dropped(spark):
    """Pairs of 0.6 to 0.79 keep both texts, although their prints are often near."""
    r, rows = random.Random(21), []
    for k in range(60):
        base = made_words(r, 300)
        copy = list(base)
        for p in range(0, 300, 300 // (8 + k % 6)):
            copy[p] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    assert not any(alike(sets[k], sets[k + 1]) for k in range(0, 120, 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.one_of_each(docs).collect()) == list(range(120))


@pytest.mark.parametrize("chunk", [2048, 9])
def test_proven_links_equal_brute_force(spark, monkeypatch, chunk):
    """A star of copies, a chain and pairs at the limit within one candidate component, whole and dealt in chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "MIDDLES", 2)
    r = random.Random(22)
    base, texts = made_words(r, 60), []
    for k in range(60):  # near to the base, and not to each other
        copy = list(base)
        copy[r.randrange(5, 55)] = f"changed{k}"
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    chain = list(base)
    for k in range(0, 60, 2):
        chain[k] = f"step{k}"
        texts.append(" ".join(chain))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by_id = {x.doc_id: x for x in simhash.copy_prints(docs).collect()}

    def grams(text):
        return sorted(x - (1 << 64) if x >> 63 else x for x in (xxh64_intdigest(b" ".join(g)) for g in shingles(text)))

    rows = [(7, k, by_id[k].p0, by_id[k].p1, grams(t)) for k, t in enumerate(texts)]
    members = spark.createDataFrame(rows, "cc long, node long, p0 long, p1 long, grams array<long>")
    roots = {x.node: x.root for x in components(simhash.proven_links(members)).collect()}
    group = plain_components([shingles(t) for t in texts], alike)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(k, least.get(g, k))
    assert [roots.get(k, k) for k in range(len(texts))] == [least[g] for g in group]


def test_added_passages_and_edits_are_found(spark):
    """Nearly all pairs of 0.8 to 0.9, by a passage added in one piece as by scattered edits."""
    r, rows = random.Random(23), []
    for k in range(120):
        base = made_words(r, 200)
        copy = list(base)
        if k % 2:
            copy += made_words(r, 47 - k % 20)
        else:
            for p in range(0, 200, 60):
                copy[p] = "changed"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    sets = [shingles(t) for _, t in rows]
    assert all(alike(sets[k], sets[k + 1]) for k in range(0, 240, 2))
    kept = {x.doc_id for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(0, 240, 2)) <= kept and len(kept) <= 121


def test_a_clean_text_stays_where_its_doc_id_is_repeated(spark):
    r = random.Random(24)
    clean, base = (" ".join(made_words(r, 40)) for _ in range(2))
    rows = [(3, base), (5, clean), (5, base + " end"), (5, clean)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == [(3, base), (5, clean)]


def test_unrelated_texts_are_no_candidates(spark):
    """Their pairs grow with the square of the input, also where all use the same words equally often."""
    r = random.Random(25)
    words = made_words(r, 60)
    texts = [r.sample(words * 4, 240) for _ in range(1200)]
    copies = [[*t[:100], "changed", *t[101:]] for t in texts[:20]]
    rows = [(k, " ".join(t)) for k, t in enumerate([*texts, *copies])]
    prints = simhash.copy_prints(spark.createDataFrame(rows, "doc_id long, text string")).drop("doc").withColumnRenamed("doc_id", "doc").cache()
    found = simhash.copy_candidates(prints).distinct().collect()
    assert sorted((x.u, x.v) for x in found) == [(1200 + k, k) for k in range(20)]


def test_only_rows_that_may_meet_a_table_are_sieved_out(spark, monkeypatch):
    from wardlight.llm import columns

    big = spark.range(20_000).selectExpr("if(id % 1000 = 0, null, id) AS a", "concat('s', id % 7) AS b", "id")
    small = big.where("id % 50 = 0").select("a", "b")
    some, clear = columns.sieved(big, small, ["a", "b"])
    some, clear = {x.id for x in some.collect()}, {x.id for x in clear.collect()}
    assert some | clear == set(range(20_000)) and not some & clear
    assert set(range(0, 20_000, 50)) <= some and len(some) < 420
    want = sorted(map(str, columns.without(big, small, ["a", "b"]).collect()))
    monkeypatch.setattr(columns, "BROADCAST_ROWS", -1)
    assert sorted(map(str, columns.without(big, small, ["a", "b"]).collect())) == want
    monkeypatch.setattr(columns, "SIEVE", 2)  # a full map lets all through
    assert sorted(map(str, columns.without(big, small, ["a", "b"]).collect())) == want


def test_one_of_each_beyond_the_broadcast_bound(odd, none, monkeypatch):
    from wardlight.llm import columns

    want = sorted(map(str, simhash.one_of_each(odd).collect()))
    monkeypatch.setattr(columns, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    assert sorted(map(str, simhash.one_of_each(odd).collect())) == want
    assert simhash.one_of_each(none).collect() == []
