"""Search operators: exactness, ties, independence of partitioning."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.functions.ranking import settle, start_trail
from wardlight.operators import guardrails as g
from wardlight.operators import lexical
from wardlight.operators.fusion import rrf
from wardlight.operators.intent import query_intent
from wardlight.operators.lexical import asked_lists, bm25_topk, bucket_of, build_lexical_index, invert, read_lexical_index, write_lexical_index
from wardlight.operators.semantic import cosine_topk
from wardlight.session import stored


@pytest.mark.parametrize("components", [1 << 18, 20])
def test_cosine_matches_brute_force(spark, components):
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(6, 8)), rng.normal(size=(50, 8))
    c[10:30] = c[10]  # many equal copies
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id bigint, embedding array<double>")
    chunks = spark.createDataFrame([(f"c{i:02d}", [float(x) for x in v]) for i, v in enumerate(c)], "frame_id string, embedding array<double>").repartition(7)
    got = {(r.query_id, r["rank"]): r.frame_id for r in cosine_topk(queries, chunks, F.lit(5), components=components).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(q) @ unit(c).T, 9)
    for i in range(6):
        order = sorted(range(50), key=lambda j: (-scores[i, j], j))[:5]
        assert [got[(i, n + 1)] for n in range(5)] == [f"c{j:02d}" for j in order]


def test_cosine_compares_vectors_of_one_size(spark, monkeypatch):
    from wardlight.operators import semantic

    monkeypatch.setattr(semantic, "SCORES", 3)
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id bigint, embedding array<double>")
    chunks = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [0.0, 1.0, 0.2]), ("c", [0.5, 0.5]), ("d", [1.0])], "frame_id string, embedding array<double>")
    got = sorted((r.query_id, r.frame_id) for r in cosine_topk(queries, chunks, F.lit(5)).collect())
    assert got == [(1, "a"), (1, "c"), (2, "b")]
    assert [(r.dim, r.n) for r in semantic.unmatched_vectors(queries, chunks).collect()] == [(1, 1)]


def test_bm25_does_not_depend_on_partitions(spark, tmp_path):
    texts = [(f"d{i}", "", " ".join(f"w{(i * j) % 17}" for j in range(1, 30))) for i in range(60)]
    chunks = spark.createDataFrame(texts, "frame_id string, title string, content string")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w16 nothing")], "query_id bigint, query string")
    results = [sorted(map(tuple, bm25_topk(queries, build_lexical_index(chunks.repartition(n)), F.lit(7), 7).collect())) for n in (1, 7, 64)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 14
    write_lexical_index(build_lexical_index(chunks), str(tmp_path / "ix"))
    stored = read_lexical_index(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, bm25_topk(queries, stored, F.lit(7), 7).collect())) == results[0]


def test_rrf_adds_pages_and_keeps_unnamed_hits_apart(spark):
    schema = "query_id bigint, frame_id string, score double, rank int"
    lex = spark.createDataFrame([(1, "a#page-1", 9.0, 1), (1, "a#page-2", 8.0, 2), (1, "", 7.0, 3)], schema)
    sem = spark.createDataFrame([(1, "a", 0.9, 1), (1, "", 0.8, 2)], schema)
    got = {r.parent_id: (r.frame_id, r.score) for r in rrf(lex, sem).collect()}
    assert got["a"] == ("a#page-1", 1 / 61 + 1 / 62 + 1 / 61)
    assert got["l2"][1] == 1 / 63 and got["s1"][1] == 1 / 62


def test_trail_reproduces_a_chain_of_stable_sorts(spark):
    rows = [(1, p, s) for p, s in enumerate([3.0, 3.0, 5.0, 1.0, 1.0], 1)]
    hits = start_trail(spark.createDataFrame(rows, "query_id bigint, pos int, score double"))
    hits = hits.withColumn("name", F.col("pos")).withColumn("score", F.lit(2.0)).withColumn("trail", F.concat(F.array("score"), "trail"))
    assert [r.name for r in settle(hits).orderBy("pos").collect()] == [3, 1, 2, 4, 5]


def test_intent_slots(spark):
    rows = [(1, "uncomplicated malaria artesunate dose in adult"), (2, "severe pneumonia in children"), (3, "hello")]
    out = {r.query_id: r for r in query_intent(spark.createDataFrame(rows, "query_id bigint, query string")).collect()}
    assert out[1].condition == "malaria" and out[1].sev_light and not out[1].sev_heavy and out[1].pop_adult and out[1].task == "dose" and out[1].is_action
    assert out[2].sev_heavy and out[2].pop_child and not out[2].is_action
    assert out[3].condition is None and out[3].coherence == [] and out[3].query == "hello"


def test_swap_moves_one_hit_and_keeps_scores(spark):
    hits = spark.createDataFrame([(1, p, 10.0 - p) for p in range(1, 5)], "query_id bigint, pos int, score double")
    out = g._swap(hits, F.col("pos").isin(3, 4), "moved").orderBy("pos").collect()
    assert [r.score for r in out] == [7.0, 9.0, 8.0, 6.0] and all(r.moved for r in out)


def test_whole_content_is_indexed_and_cut_by_the_request(spark):
    """A word far behind the usual cut is found; the request's length cuts what is returned; nameless chunks stay apart."""
    from wardlight.operators.chunks import normalize_chunks
    from wardlight.plans.search import Corpus, search
    from wardlight.schemas import CHUNKS_RAW
    from wardlight.sources.requests import with_defaults

    names = [f.name for f in CHUNKS_RAW]
    row = lambda **k: tuple(k.get(n) for n in names)
    long = "malaria dose " * 2000 + "zebrafish " + "end " * 3000
    raw = spark.createDataFrame([
        row(frame_id="a", title="A", snippet=long, uri="u/a", metadata={"content_type": "recommendation"}),
        row(frame_id=None, title="N1", snippet="one zebrafish text", uri="u/n", metadata={"content_type": "recommendation"}),
        row(frame_id="", title="N2", snippet="another zebrafish text", uri="u/n", metadata={"content_type": "recommendation"}),
        row(frame_id="e", title="zebrafish zebrafish", snippet="chunk_id: 5", uri="u/e", metadata={"content_type": "recommendation"}),
    ], CHUNKS_RAW)
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "frame_id string, embedding array<double>")
    corpus = Corpus.of(normalize_chunks(raw, "S"), vectors)
    asked = with_defaults(spark.createDataFrame([(1, "zebrafish", "bm25", 30000), (2, "zebrafish", "bm25", 100)], "query_id bigint, query string, search_mode string, snippet_chars int"))
    none = spark.createDataFrame([], "query_id bigint, embedding array<double>")
    got = {r.query_id: r for r in search(asked, corpus, none).collect()}
    for q, n in ((1, 30000), (2, 100)):
        hits = {h.title: h for h in got[q].hits}
        assert set(hits) == {"A", "N1", "N2"} and len(hits["A"].content) == n
        assert hits["N1"].frame_id == hits["N2"].frame_id == ""
    assert "zebrafish" in {h.title: h for h in got[1].hits}["A"].content


def _index(spark, n=600, **more):
    texts = [(f"d{i:03d}", f"t{i % 7}", " ".join(f"w{(i * j) % 97}" for j in range(1, 30 + i % 5))) for i in range(n)] + [("same", "", "w1 w1 w2")] * 3 + [("empty", "", "")]
    chunks = spark.createDataFrame(texts, "frame_id string, title string, content string")
    return chunks, build_lexical_index(chunks.repartition(5))


def test_inverted_index_holds_the_postings(spark):
    _, forward = _index(spark)
    for shard_chunks in (50, 8192):
        found = invert(forward, shard_chunks=shard_chunks)
        assert sorted(map(tuple, found.postings.collect())) == sorted(map(tuple, forward.postings.collect()))
        blocks = found.lists.where("size(peaks) <> ceil(n / 128) OR n <> size(ords)")
        assert blocks.count() == 0


def _stages(spark):
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
    return [stages.apply(k) for k in range(stages.size())]


def test_index_moves_only_its_postings(spark):
    """Entries are not shuffled to their shards; only the rows go to their folders."""
    _, forward = _index(spark)
    entries = stored(forward.entries)
    before = sum(s.shuffleWriteRecords() for s in _stages(spark))
    found = invert(lexical.index_of(entries), shard_chunks=50)
    moved = sum(s.shuffleWriteRecords() for s in _stages(spark)) - before
    assert moved <= found.rows.count() + 20


def test_a_corpus_is_indexed_without_entries_and_shuffles(spark):
    """words go to shards in one task; neither entries nor postings are written or shuffled on the way."""
    from wardlight.plans.search import Corpus

    chunks, forward = _index(spark)
    chunks = chunks.unionByName(spark.createDataFrame([("odd", "İstanbul ǅ", "x\u0301y ²³ 1,5 ﬁn ΑΣ ٣٤ \U0001d400b")], chunks.schema)).withColumnRenamed("frame_id", "chunk_id")
    forward = build_lexical_index(chunks, "chunk_id")
    want = sorted(map(tuple, forward.postings.collect()))
    stats = tuple(lexical.index_of(forward.entries).stats.first())
    tables = stored(chunks)
    before = sum(s.shuffleWriteRecords() for s in _stages(spark)), sum(s.outputRecords() for s in _stages(spark))
    corpus = Corpus.of(tables, None)
    moved, written = (sum(f(s) for s in _stages(spark)) - b for f, b in zip((lambda s: s.shuffleWriteRecords(), lambda s: s.outputRecords()), before, strict=True))
    assert sorted(map(tuple, corpus.index.postings.collect())) == want
    assert tuple(corpus.index.stats.first())[:2] == stats
    assert corpus.index.lists.where("peaks IS NOT NULL").count() == 0
    queries = spark.createDataFrame([(i, f"w{i} w{i * 7 % 97} t1 y nothing") for i in range(30)], "query_id bigint, query string")
    best = [sorted(map(tuple, bm25_topk(queries, index, F.lit(9), 9).collect())) for index in (corpus.index, invert(forward))]
    assert best[0] == best[1] and len(best[0]) == 270
    assert moved <= 20  # counts of the tasks
    assert written == chunks.count() + corpus.index.rows.count() + 1


@pytest.mark.parametrize("postings", [1, 100])
def test_shards_hold_a_bounded_number_of_postings(spark, monkeypatch, postings):
    _, forward = _index(spark)
    want = sorted(map(tuple, forward.postings.collect()))
    monkeypatch.setattr(lexical, "SHARD_POSTINGS", postings)
    kernel = lexical._invert_kernel(1.0, 8192)
    monkeypatch.setattr(lexical, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    batches = stored(forward.entries).toArrow().to_batches(40)
    rows = [r for b in kernel(iter(batches)) for r in b.to_pylist()]
    names = {r["shard"]: r["names"] for r in rows if r["term"] is None}
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += r["n"] or 0
    assert len(names) > 1 and all(sizes[s] <= postings or len(names[s]) == 1 for s in names)
    assert sorted((r["term"], names[r["shard"]][o], tf, n) for r in rows if r["term"] for o, tf, n in zip(r["ords"], r["tfs"], r["lens"], strict=True)) == want


def test_search_opens_only_the_folders_of_its_terms(spark):
    _, forward = _index(spark)
    found = invert(forward)
    asked = spark.createDataFrame([("w1",), ("nowhere",)], "term string").withColumn("bucket", bucket_of(F.col("term"), 8))
    lists = asked_lists(stored(asked), found, 2)
    rows = lists.collect()
    assert {r.term for r in rows} == {"w1"}
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan and "PartitionFilters" in plan


def test_shards_and_blocks_do_not_change_the_result(spark, monkeypatch):
    chunks, forward = _index(spark)
    queries = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(6)) + " w1 t1 nothing") for i in range(40)], "query_id bigint, query string")
    want = sorted(map(tuple, bm25_topk(queries, invert(forward), F.lit(9), 9).collect()))
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    assert sorted(map(tuple, bm25_topk(queries, invert(forward, shard_chunks=40), F.lit(9), 9).collect())) == want
    n, avg = 604, forward.stats.first().avg_len
    texts = {}
    for r in chunks.collect():
        texts.setdefault(r.frame_id, []).append((r.title + " " + r.content).split())
    df = Counter(t for x in texts.values() for w in x for t in set(w))
    for q in queries.collect()[:5]:
        scores = []
        for name, copies in texts.items():
            for w in copies:
                hits = [t for t in set(q["query"].split()) if t in w]
                gain = lambda t: math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * (w.count(t) * 2.2) / (w.count(t) + 1.2 * (1 - 0.75 + 0.75 * len(w) / avg))  # noqa: E731, B023
                if hits:
                    scores.append((-sum(math.floor(gain(t) * 1e6 + 0.5) for t in hits), name))
        assert [(-s / 1e6, f) for s, f in sorted(scores)[:9]] == [(r[2], r[1]) for r in sorted(want, key=lambda r: r[3]) if r[0] == q.query_id]


def test_skipping_loses_no_chunk():
    """Random postings of very different weight: the result with upper bounds equals the whole sums."""
    rng = np.random.default_rng(2)
    for case in range(60):
        n, k = int(rng.integers(1, 900)), int(rng.integers(1, 12))
        terms, total, seen = [], np.zeros(n, np.int64), np.zeros(n, bool)
        for _ in range(int(rng.integers(1, 9))):
            ords = np.flatnonzero(rng.random(n) < rng.random() ** 2).astype(np.int32)
            if not len(ords):
                continue
            tfs, lens = rng.integers(1, 9, len(ords)), rng.integers(1, 50, len(ords))
            first, second = lexical._gain(tfs.astype(float), lens, 20.0)
            peaks = np.maximum.reduceat(first / second, np.arange(0, len(ords), lexical.BLOCK))
            term = lexical._Term(ords, tfs, lens, peaks, float(rng.choice([1e-9, 0.01, 1.0, 9.0])), 20.0)
            assert all(term.gains <= term.peaks[np.arange(len(ords)) // lexical.BLOCK])
            terms.append(term)
            total[ords] += term.gains
            seen[ords] = True
        found, scores = lexical.best_chunks(terms, n, k)
        want = sorted(((-int(total[i]), i) for i in np.flatnonzero(seen)))[:k]
        assert [(-int(s), int(i)) for i, s in zip(found, scores, strict=True)] == want, case


def test_lsh_recall(spark):
    """At least 0.9 of the exact best, over all query vectors of the given table."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    chunks = rows.select(F.col("vec_id").cast("string").alias("frame_id"), "embedding")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact, near = ({(r.query_id, r.frame_id) for r in cosine_topk(queries, chunks, F.lit(15), mode=m).collect()} for m in ("exact", "lsh"))
    assert len(exact) == 1500 and len(exact & near) >= 0.9 * len(exact)


def test_lsh_moves_vectors_once(spark):
    """Rows shuffled do not grow with the hash tables nor with the pairs that share a bucket."""
    vectors = spark.range(2000).select(F.col("id").cast("string").alias("frame_id"), F.array(F.lit(1.0), F.rand(3), F.rand(4), F.rand(5)).alias("embedding"))
    queries = vectors.limit(40).select(F.col("frame_id").cast("bigint").alias("query_id"), "embedding")
    vectors, queries = stored(vectors), stored(queries)

    def shuffled():
        store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
        none = spark._jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    assert cosine_topk(queries, vectors, F.lit(5), mode="lsh").count() == 200
    assert shuffled() - before < 2 * 2000


def test_pooling_moves_a_row_for_each_task_and_key(spark, monkeypatch):
    from wardlight.operators import semantic

    rng = np.random.default_rng(1)
    rows = [(("a", "b", None)[i % 3], [float(x) for x in rng.normal(size=5)]) for i in range(300)] + [("one", [3.0, 4.0]), ("none", None), ("none", [])]
    frame = spark.createDataFrame(rows, "k string, embedding array<double>").repartition(6)
    for keys in (50_000, 1):
        monkeypatch.setattr(semantic, "KEYS", keys)
        got = {r.k: r for r in semantic.pool_embeddings(frame, "k").collect()}
        assert set(got) == {"a", "b", None, "one"} and list(got["one"].embedding) == [3.0, 4.0]
        for name in ("a", "b", None):
            mean = np.mean([v for k, v in rows[:300] if k == name], axis=0)
            assert got[name].windows == 100 and np.allclose(got[name].embedding, mean / np.linalg.norm(mean), atol=1e-9)
    plan = semantic.pool_embeddings(frame, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def _patterns(plan):
    """First characters of the second argument of every RLIKE."""
    at = plan.find("RLIKE(")
    while at >= 0:
        k, depth = at + 6, 0
        while depth or plan[k] != ",":
            depth += (plan[k] in "([") - (plan[k] in ")]")
            k += 1
        yield plan[k + 2:k + 4]
        at = plan.find("RLIKE(", at + 1)


def test_patterns_are_constants(spark):
    """No pattern of a search comes out of a column: every one is a literal that Spark compiles once."""
    from wardlight.workload import registry

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 30))
    for name in ("r25_search_responses", "v14_federated_responses"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        found = list(_patterns(plan))
        assert len(found) > (100 if name.startswith("r25") else 10) and set(found) == {"(?"}
