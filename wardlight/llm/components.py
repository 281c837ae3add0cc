"""Connected components of an edge table, by alternating stars over written tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _least(pairs: DataFrame) -> DataFrame:
    """u and the least of its v; map-side minima keep hot nodes small in the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each larger neighbour of u to the least node around u."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(_least(both).select("u", F.least("u", "m").alias("m")))  # a written side lets Spark split a hot u in the join
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the least of them."""
    least = stored(_least(edges))
    rest = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node that has an edge and is not the least of its component.

    ``edges`` has long columns u > v. Each round is written to the shared folder, so
    a lost executor costs a re-read; rounds grow with the logarithm of the longest chain.
    """
    now = stored(edges.select("u", "v").distinct())
    before = None
    state = _state(now)
    while state != before:
        before = state
        now = stored(_small_star(stored(_large_star(now))))
        state = _state(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
