"""Stable ranking.

Every scoring stage of a search re-sorts its hits and keeps the previous order
among equal scores.  A hit therefore carries ``trail``: its score after each
stage, latest first.  Sorting by the trail (descending) and the arrival position
gives the order that the chain of stable sorts would give, in a single sort.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def start_trail(hits: DataFrame) -> DataFrame:
    return hits.withColumn("trail", F.array("score"))


def rescored(hits: DataFrame, score: Column) -> DataFrame:
    """Replace the score and note it as the latest stage."""
    return hits.withColumn("score", score).withColumn("trail", F.concat(F.array("score"), "trail"))


def by_trail(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.col("trail").desc(), F.col("pos"))


def settle(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """Turn the trail into a new position (1, 2, ...) and restart it."""
    return start_trail(hits.withColumn("pos", F.row_number().over(by_trail(key))))


def factor(condition: Column, value) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(1.0))


def top_k(hits: DataFrame, key: str, k: Column, *order) -> DataFrame:
    """First k rows of each key as ``rank``; Spark prunes per task before the shuffle."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
