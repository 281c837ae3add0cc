"""Comparison of two search runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_runs(a: DataFrame, b: DataFrame, strict_source: bool = False) -> DataFrame:
    """Per query: source, presence of content, match; ``failure`` says what is wrong.

    Each run: query_id, query, source, content of the top hit.
    """
    left = a.select("query_id", F.col("query").alias("q_a"), F.col("source").alias("s_a"), F.col("content").alias("c_a"))
    right = b.select("query_id", F.col("query").alias("q_b"), F.col("source").alias("s_b"), F.col("content").alias("c_b"))
    both = left.join(right, "query_id", "full")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    out = both.select(
        "query_id", F.coalesce("q_a", "q_b").alias("query"),
        F.coalesce("s_a", F.lit("none")).alias("source_a"), F.coalesce("s_b", F.lit("none")).alias("source_b"),
        has("c_a").alias("has_content_a"), has("c_b").alias("has_content_b"),
        F.coalesce(F.col("s_a") == F.col("s_b"), F.lit(False)).alias("source_match"),
    )
    failure = F.when(~F.col("has_content_a") | ~F.col("has_content_b"), "missing content")
    if strict_source:
        failure = failure.when(~F.col("source_match"), "source mismatch")
    return out.withColumn("failure", failure)
