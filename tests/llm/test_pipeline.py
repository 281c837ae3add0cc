"""The pipeline's stages, each against a plain version on its own input."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from test_dedup import plain_components, repeats
from wardlight.llm import quality_classifier as qc
from wardlight.llm import quality_rules as qr
from wardlight.llm import simhash
from wardlight.llm.queries import QUERIES, WORD_BPE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Input and result of each stage."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_in_order_with_columns_of_documents(staged):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "simhash near-dedup", "substring dedup", "best-fit packing"]
    for before, after in staged[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_classifier_stage(spark, staged):
    docs, kept = staged[0]
    model = qc.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    rows = qc.classify(docs, model).collect()
    sites = defaultdict(list)
    for r in rows:
        sites[r.host, r.path].append(r.evidence)

    def weight(groups):
        n = np.array([len(g) for g in groups])
        total, squares = np.array([sum(g) for g in groups]), sum(x * x for g in groups for x in g)
        every, k = n.sum(), len(n)
        within = max(0.0, squares - (total ** 2 / n).sum()) / max(1, every - k)
        between = max(0.0, ((total ** 2 / n).sum() - total.sum() ** 2 / every) / (k - 1) - within) / ((every - (n ** 2).sum() / every) / (k - 1))
        return min(1e6, max(1.0, within / between)) if between > 0 else 1e6

    hosts = defaultdict(list)
    for (host, _), p in sites.items():
        hosts[host] += p
    mean = sum(r.evidence for r in rows) / len(rows)
    k_host, k_path = weight(list(hosts.values())), weight(list(sites.values()))
    good = set()
    for r in rows:
        prior = (k_host * mean + sum(hosts[r.host])) / (k_host + len(hosts[r.host]))
        own = sites[r.host, r.path]
        site = min(1 - 1e-6, max(1e-6, (k_path * prior + sum(own) - r.evidence) / (k_path + len(own) - 1)))
        odds = math.log(r.evidence / (1 - r.evidence)) + math.log(site / (1 - site)) - math.log(mean / (1 - mean)) if 0 < r.evidence < 1 else (50 if r.evidence else -50)
        assert abs(r.site_rate - site) < 1e-6 and abs(r.score - 1 / (1 + math.exp(-odds))) < 1e-6
        good |= {r.doc_id} if r.kept else set()
    assert {x.doc_id for x in kept.collect()} == good


def test_rules_stage(staged):
    docs, kept = staged[1]
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = {d for (d,) in con.execute(f"SELECT doc_id FROM ({qr.ORACLE}) WHERE kept").fetchall()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want
    for r in rows:  # what is left are lines of the text in order
        lines = iter(texts[r.doc_id].split("\n"))
        assert all(any(x == y for y in lines) for x in r.text.split("\n"))


def test_near_duplicate_stage(staged):
    """By brute force: texts are linked if their sets of five-word shingles share 0.8 or more."""
    docs, kept = staged[2]
    rows = [(r.doc_id, frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))) for r in docs.collect() for w in [r.text.split()]]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    group = plain_components(rows, lambda a, b: alike(a[1], b[1]))
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        least[g] = min(d, least.get(g, d))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    assert len(least) < len(rows)


def test_substring_stage(staged):
    docs, cut = staged[3]
    want = sorted((d, b" ".join(k)) for d, _, k in repeats([(r.doc_id, r.text) for r in docs.collect()], 13))
    assert sorted((r.doc_id, b" ".join(r.text.encode().split())) for r in cut.collect()) == want


def test_packing_stage_and_run(spark, staged):
    docs, packed = staged[4]
    tool, want = Tokenizer.from_file(WORD_BPE), Counter()
    for r in docs.collect():
        ids = np.array([*tool.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r.doc_id, k // 4096, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())] += 1
    pieces = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(packed) == want == pieces(corpus_pipeline.run(spark, FOLDER))


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
