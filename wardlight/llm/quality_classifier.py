"""Quality classifier with hierarchical empirical Bayes.

A logistic model over text measures, fitted on a bounded sample of labelled rows,
gives each document evidence p. Grouped sums give each host and each path of a host
(its language) their mean evidence. Host means are shrunk towards the global mean and
path means towards their host, by prior weights estimated with the method of moments
from the spread between groups; sparse sites so stay near the prior. A document's
own evidence is left out of its site. Its score is its log-odds moved by the shift of
its path from the global mean.

Only doc_id, text, source and lang are read. A null text is empty, null source or
lang is ''. Rows that repeat are documents of their own. Empty tables give no rows;
with labels of one kind only, or none, the evidence is the share of good labels (0.5
with none). Labels that are null, or whose document is missing, take no part.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .columns import let, lines_with_words, lookup, share, words

#: Labelled rows that the model is fitted on, at most; chosen by hash of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.5
FEATURES = ["symbols", "upper", "digits", "bars", "marks", "next_same", "distinct", "log_words", "distinct_by_log", "word_length", "no_words", "line_repeats"]


def features(text: Column) -> Column:
    """Array of the measures in FEATURES, worked out in one reading of the words."""
    length = F.length(text).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def of_words(w: Column) -> Column:
        n = F.size(w).cast("double")
        same = F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("double")
        distinct = share(F.size(F.array_distinct(w)).cast("double"), n)
        return F.array(share(same, n), distinct, F.log1p(n), distinct * F.log1p(n), share(length, n) / 10, (n < 10).cast("double"))

    lines = let(lines_with_words(text), lambda x: share((F.size(x) - F.size(F.array_distinct(x))).cast("double"), F.size(x).cast("double")))
    head = F.array(*[share(count(p), length) for p in ("[#*$%&<>]", r"\p{Lu}", "[0-9]", r"\|", "[!?]")])
    return F.concat(head, let(words(text), of_words), F.array(lines))


@dataclass(frozen=True)
class Model:
    """Weights over standardised measures."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def logit(self, measures: Column) -> Column:
        terms = F.zip_with(measures, F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("s"), F.lit(w).alias("w")) for m, s, w in zip(self.mean, self.scale, self.weights, strict=True)]),
                           lambda x, p: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (x - p["m"]) / p["s"])) * p["w"])
        return F.lit(self.bias) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def fit_rows(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([z, np.ones((len(z), 1))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(tuple(map(float, mean)), tuple(map(float, scale)), tuple(map(float, w[:-1])), float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(stored(chosen)), "doc_id")
    rows = rows.select(features(F.col("text")).alias("x"), "quality").orderBy(F.xxhash64("x", "quality")).limit(sample).collect()  # at most ``sample`` rows of 12 numbers
    y = np.array([min(1, max(0, r[1])) for r in rows], float)
    if len(y) == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        n = len(FEATURES)
        return Model((0.0,) * n, (1.0,) * n, (0.0,) * n, float(np.log(rate / (1 - rate))))
    return fit_rows(np.array([r[0] for r in rows]), y)


def _probability(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _weight(groups: DataFrame) -> float:
    """Prior weight, in documents, from the spread of group means: within variance over between variance."""
    n, total, squares = F.col("n"), F.col("total"), F.col("squares")
    row = groups.where("n > 0").agg(
        F.sum(n), F.sum(total), F.sum(squares), F.sum(total * total / n), F.count("*"), F.sum(n * n)).first()
    if not row[0] or row[4] < 2:
        return 1.0
    every, mean, k = row[0], row[1] / row[0], row[4]
    within = max(0.0, row[2] - row[3]) / max(1, every - k)
    usual = (every - row[5] / every) / (k - 1)
    between = max(0.0, (row[3] - every * mean * mean) / (k - 1) - within) / max(usual, 1e-9)
    return float(min(1e6, max(1.0, within / between))) if between > 0 else 1e6


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """host, path, host_rate (posterior mean of the host), path_total, path_n, weight; and the global mean.

    ``evidence`` has host, path and p. Both levels are sums with map-side partial results.
    """
    paths = stored(evidence.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")))
    hosts = stored(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")))
    row = hosts.agg(F.sum("total"), F.sum("n")).first()
    mean = row[0] / row[1] if row[1] else 0.5
    k_host, k_path = _weight(hosts), _weight(paths)
    rates = hosts.select("host", ((F.lit(k_host) * F.lit(mean) + F.col("total")) / (F.lit(k_host) + F.col("n"))).alias("host_rate"))
    table = paths.join(rates, "host").select(
        "host", "path", "host_rate", F.col("total").alias("path_total"), F.col("n").alias("path_n"), F.lit(k_path).alias("weight"))
    return stored(table), mean


def _judged(rows: DataFrame, threshold: float) -> DataFrame:
    """``rows`` (with host, path and logit) plus evidence, site_rate, score, kept."""
    evidence = rows.select("host", "path", _probability(F.col("logit")).alias("p"))
    table, mean = site_posteriors(evidence)
    joined = lookup(rows, table, ["host", "path"], "inner", F.col("logit"))
    p = _probability(F.col("logit"))
    site = (F.col("weight") * F.col("host_rate") + F.col("path_total") - p) / (F.col("weight") + F.col("path_n") - 1)
    site = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), site))
    middle = min(1 - 1e-6, max(1e-6, mean))
    joined = joined.withColumn("evidence", p).withColumn("site_rate", site)
    shift = F.log(F.col("site_rate") / (1 - F.col("site_rate"))) - F.lit(float(np.log(middle / (1 - middle))))
    joined = joined.withColumn("score", _probability(F.col("logit") + shift))
    return joined.withColumn("kept", F.col("score") >= threshold)


def _sites(docs: DataFrame, model: Model, *more) -> DataFrame:
    logit = model.logit(features(F.coalesce("text", F.lit(""))))
    return docs.select(*more, F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), logit.alias("logit"))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence, site_rate, score, kept of each row."""
    return _judged(stored(_sites(docs, model, "doc_id")), threshold).select("doc_id", "host", "path", "evidence", "site_rate", "score", "kept")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` with a score of at least the threshold, columns as given."""
    return _judged(_sites(docs, model, F.struct("*").alias("row")), threshold).where("kept").select("row.*")
