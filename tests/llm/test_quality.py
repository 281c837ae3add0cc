"""Quality rules against SQL, and the classifier on held-out labels."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import quality_classifier as qc
from wardlight.llm import quality_rules as qr


def test_rules_equal_sql(odd, none, spark):
    docs = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    lines = [(1000 + k, "A common  line of this host\n" + ("only a few words" if k % 2 else " ".join(f"w{k}x{j}" for j in range(30))), "en", "s0") for k in range(30)]
    docs = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(lines, "doc_id long, text string, lang string, source string"))
    table = docs.toArrow()
    con = duckdb.connect()
    con.register("documents", table)
    cur = con.execute(qr.ORACLE)
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall())
    got = qr.judge(docs).select(names).collect()
    assert sorted(tuple(r) for r in got) == want
    gone = {r.doc_id for r in got if not r.kept and not r.base_failed}
    assert gone == {d for d, t, *_ in lines if "only" in t}
    assert qr.judge(none).collect() == []


def test_rows_stay_rows(odd):
    got = qr.judge(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    same = [r for r in got if r.doc_id == 4]
    assert len(same) == 2 and same[0] == same[1]


def test_apply_drops_and_cuts(odd, none):
    kept = qr.apply_rules(odd)
    assert kept.columns == odd.columns and [f.dataType for f in kept.schema] == [f.dataType for f in odd.schema]
    judged = {r.doc_id for r in qr.judge(odd).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == judged
    assert qr.apply_rules(none).collect() == []


def test_frequent_lines_are_cut(spark):
    rows = [(k, f"Cookie NOTICE text\n{' '.join(f'w{k}x{j}' for j in range(20))}", "s", 0) for k in range(20)] + [(50 + k, "copy of a text\n" + "its second line is here with enough words to be kept", "s", 0) for k in range(30)]
    out = {r.doc_id: r for r in qr.apply_rules(spark.createDataFrame(rows, "doc_id int, text string, source string, n_chars int")).collect()}
    assert sorted(out) == list(range(20))  # thirty documents hold each line of the copied text, so nothing of it is left
    assert all("Cookie" not in r.text and r.n_chars == len(r.text) for r in out.values())


def test_rows_of_one_document_count_once_and_large_hosts_like_small(spark):
    line = "A line of this host that one document repeats"
    rows = [(7, line + "\n" + " ".join(f"w{j}" for j in range(20)), "s")] * 30
    rows += [(100 + k, f"Footer of the host\n{' '.join(f'w{k}x{j}' for j in range(20))}", "s") for k in range(11)]
    rows += [(1000 + k, " ".join(f"w{k}y{j}" for j in range(20)), "s") for k in range(900)]
    found = qr.frequent_lines(spark.createDataFrame(rows, "doc_id int, text string, source string")).collect()
    assert [r.n for r in found] == [11]


def test_plans_are_native(odd):
    for df in (qr.judge(odd), qr.apply_rules(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_classifier_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = qc.fit(docs, labels.where("doc_id % 2 = 0"), sample=1500)
    rows = qc.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("kept", "quality").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [not r.kept for r in rows if r.quality == 0]
    assert len(good) > 300 and np.mean(good) > 0.98 and np.mean(bad) > 0.85


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [("big", "p", 0.9)] * 400 + [("small", "p", 0.1)] * 2 + [("mid", "q", 0.5)] * 50 + [("mid", "r", 0.3)] * 60
    table, mean = qc.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    rate = {r.host: r.host_rate for r in table.collect()}
    assert abs(mean - sum(r[2] for r in rows) / len(rows)) < 1e-9
    assert abs(rate["big"] - 0.9) < 0.02 and 0.1 < rate["small"] < mean


def test_odd_rows_and_labels(odd, none, spark):
    labels = spark.createDataFrame([(9, 1), (13, 0), (13, 0), (None, 1), (4, None), (999, 0)], "doc_id long, quality int")
    model = qc.fit(odd, labels)
    got = qc.classify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    kept = qc.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert qc.classify(none, model).collect() == [] and qc.keep_good(none, model).collect() == []
    for some in (labels.where("false"), labels.where("quality = 1")):
        flat = qc.fit(odd, some)
        assert set(flat.weights) == {0.0}
    assert qc.fit(none, labels).bias == 0.0


def test_salted_joins_give_the_same(odd, spark, monkeypatch):
    """Beyond the broadcast bound small tables meet salted rows."""
    from wardlight.llm import columns, warc

    lines = [(1000 + k, "a common line\n" + " ".join(f"w{k}x{j}" for j in range(30)), "en", "s0") for k in range(30)]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(lines, "doc_id long, text string, lang string, source string"))
    pages = spark.createDataFrame([(k, "u", f"{'x' * 1500}{k % 3}") for k in range(20)], "page_id long, url string, html string")
    model = qc.fit(docs, spark.createDataFrame([(9, 1), (13, 0), (12, 0), (8, 1)], "doc_id long, quality int"))

    def results():
        tables = qr.judge(docs), qr.apply_rules(docs), qc.classify(docs, model), warc.read_packages(warc.write_packages(pages))
        return [sorted(map(str, t.collect())) for t in tables]

    first = results()
    monkeypatch.setattr(columns, "BROADCAST_ROWS", -1)
    assert results() == first


def test_features_are_as_named(spark):
    x = spark.range(1).select(qc.features(F.lit("Aa aa aa #1|\nAa aa aa #1|\n")).alias("x")).first().x
    assert len(x) == len(qc.FEATURES)
    named = dict(zip(qc.FEATURES, x, strict=True))
    assert named["line_repeats"] == 0.5 and named["no_words"] == 1.0 and named["bars"] == 2 / 26 and named["upper"] == 2 / 26 and named["next_same"] == 2 / 8


def test_pipeline_count_does_not_grow_with_the_host(spark):
    """A line of 15 documents goes on a host of 40 as on one of 400, and no array of a host's lines rides on its documents."""
    import corpus_pipeline

    rows = [(1000 * size + k, ("Cookie notice of this host\n" if k < 15 else "") + " ".join(f"w{size}x{k}x{j}" for j in range(20)), f"s{size}") for size in (40, 400) for k in range(size)]
    out = corpus_pipeline.rules(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), None).collect()
    assert len(out) == 440 and not any("Cookie" in r.text for r in out)


def test_rules_beyond_the_broadcast_bound(odd, none, spark, monkeypatch):
    """Texts that hold no frequent line need not move; the others meet theirs in a join."""
    from wardlight.llm import columns

    lines = [(1000 + k if k else None, "a common line\n" + " ".join(f"w{k}x{j}" for j in range(30)), "en", None if k % 2 else "s0") for k in range(60)]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(lines, "doc_id long, text string, lang string, source string"))
    want = sorted(map(str, qr.apply_rules(docs).collect()))
    for module in (columns, qr):
        monkeypatch.setattr(module, "BROADCAST_ROWS", -1)
    assert sorted(map(str, qr.apply_rules(docs).collect())) == want and not any("common" in x for x in want)
    assert qr.apply_rules(none).collect() == []
