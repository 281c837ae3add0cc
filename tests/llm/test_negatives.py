"""Hard negatives against brute force and SQL."""

import itertools
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import negatives
from wardlight.llm.queries import QUERIES

SCHEMA = "vec_id long, label int, vector array<long>, key binary, anchor int"


def plain(rows, is_anchor, positives=5, wanted=3, low=50, high=95):
    out = []
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2]]
    for a in rows:
        if not is_anchor(a[0]):
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2], strict=True))  # noqa: E731, B023
        others = sorted(((-score(r), r[0], r[1]) for r in rows if r[0] != a[0] and len(r[2]) == len(a[2])), key=lambda x: x[:2])
        for s, p, _ in [x for x in others if x[2] == a[1]][:positives]:
            fits = [x for x in others if x[2] != a[1] and -low * s <= -100 * x[0] <= -high * s][:wanted]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return Counter(out)


def _rows(seed, most=9):
    r = np.random.default_rng(seed)
    rows = [(k, int(r.integers(0, 3)), [int(x) for x in r.integers(-1, most, 6)], b"x", 1) for k in range(220)]
    rows += [(300 + k, 1, [3, 3, 3, 3, 3, 3], b"x", 1) for k in range(60)]  # many equal rows of one label
    rows += [rows[10], (10, 2, [4] * 6, b"x", 1), (400, 0, [0] * 6, b"x", 1), (410, 0, [0] * 6, b"x", 1), (401, 1, [0] * 6, b"x", 1)]
    rows += [(None, 1, [1] * 6, b"x", 1), (20, None, [1] * 6, b"x", 1), (30, 1, None, b"x", 1), (40, 1, [], b"x", 1), (50, 1, [5, 5], b"x", 1), (51, 1, [6, 5], b"x", 1), (52, 2, [4, 4], b"x", 1)]
    return rows


@pytest.mark.parametrize("components", [1 << 19, 120])
def test_equals_brute_force(spark, monkeypatch, components):
    """With nulls, ties, repeated ids, vectors of two sizes, clashing columns, and many cells."""
    monkeypatch.setattr(negatives, "COMPONENTS", components)
    rows = _rows(3)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = Counter(map(tuple, negatives.mine(frame, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain(rows, lambda i: i % 10 == 0) and len(got) > 100
    assert negatives.mine(frame.where("false"), F.col("vec_id") % 10 == 0).collect() == []


def test_anchors_meet_their_positives_before_they_are_repeated(spark, monkeypatch):
    """op12, F1: a join counts rows repeated for the shards by their files, and broadcast what the driver could not hold."""
    plans, keep = [], negatives.stored
    monkeypatch.setattr(negatives, "COMPONENTS", 120)
    monkeypatch.setattr(negatives, "stored", lambda df, **how: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, **how))[1])
    rows = _rows(4)
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 10 == 0)
    assert Counter(map(tuple, got.collect())) == plain(rows, lambda i: i % 10 == 0)
    steps = [[(len(re.match(r"[ :+-]*", line)[0]), line.lstrip(" :+-")) for line in plan.splitlines()] for plan in plans]
    assert any(step.startswith("Generate explode") for lines in steps for _, step in lines)
    for lines in steps:
        for k, (depth, step) in enumerate(lines):
            below = itertools.takewhile(lambda x: x[0] > depth, lines[k + 1:])  # noqa: B023
            assert not (step.startswith("Join") and any(x.startswith("Generate explode") for _, x in below)), step


def test_scores_beyond_doubles_are_exact(spark):
    big = (1 << 28) + 1
    rows = [(k, k % 2, [big + k, big - k, k], b"", 0) for k in range(40)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert Counter(map(tuple, negatives.mine(frame, F.col("vec_id") == 0, low=50, high=100).collect())) == plain(rows, lambda i: i == 0, high=100)


def test_keys_sort_like_their_parts():
    r = np.random.default_rng(1)
    anchor, score, ids = (r.integers(-4, 4, 300) * (1 << s) for s in (40, 50, 3))
    keys = negatives.pack(anchor, score, 1, ids)
    assert list(zip(*negatives.unpack(keys), strict=True)) == [(a, s, 1, i) for a, s, i in zip(anchor.tolist(), score.tolist(), ids.tolist(), strict=True)]
    order = sorted(range(300), key=lambda k: keys[k].as_py())
    assert [(anchor[k], -score[k], ids[k]) for k in order] == sorted(zip(anchor.tolist(), (-score).tolist(), ids.tolist(), strict=True))


def test_registered_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    got = sorted(map(tuple, QUERIES["op12_hard_negatives"](spark, folder).collect()))
    assert got and got == sorted(con.execute(negatives.ORACLE).fetchall())
