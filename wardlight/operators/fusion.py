"""Candidate lists of a search: pool size, rank fusion, mode dispatch."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import RulePack
from .chunks import NAMELESS

# fixed values: fusion bias and the bounds of a widened pool
RRF_K = 60
RANKS = 1_000_000
POOL_FACTOR, POOL_MIN, POOL_MAX = 3, 15, 50


def parent_of(frame_id: Column) -> Column:
    return F.substring_index(frame_id, "#", 1)


def pool_size(pack: RulePack, k: Column, is_action: Column) -> Column:
    if pack.pool_limit is not None:
        return F.lit(pack.pool_limit)
    wide = F.least(F.greatest(k * POOL_FACTOR, F.lit(POOL_MIN)), F.lit(POOL_MAX))
    return F.when(is_action, wide).otherwise(k).cast("int")


def _listed(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    columns = ["query_id", "rank", "frame_id", "score"]
    return lexical.select(F.lit(0).alias("list_ord"), *columns).unionByName(
        semantic.select(F.lit(1).alias("list_ord"), *columns))


def _merge(listed: DataFrame, fuse: Column, k: int) -> DataFrame:
    """One row per query and parent (where fused) or hit; at most two short lists meet per query."""
    unnamed = F.concat(F.when(F.col("list_ord") == 0, "l").otherwise("s"), (F.col("rank") - 1).cast("string"))
    nameless = F.coalesce("frame_id", F.lit("")) == ""
    parent = F.when(nameless | F.col("frame_id").startswith(NAMELESS), unnamed).otherwise(parent_of(F.col("frame_id")))
    named = listed.withColumn("_fuse", fuse).withColumn("parent_id", F.when(F.col("_fuse"), parent).otherwise(F.col("frame_id")))
    places = F.array_sort(F.collect_list(F.struct("list_ord", "rank", "frame_id", "score")))
    merged = named.groupBy("query_id", "parent_id", "_fuse").agg(places.alias("_places"))
    total = F.aggregate("_places", F.lit(0.0), lambda acc, p: acc + F.lit(1.0) / (F.lit(k) + p["rank"]))
    first = F.element_at("_places", 1)
    # arrival order: all of the first list, then what the second list adds; ranks are at most RANKS
    arrival = first["rank"] + F.when(F.col("_fuse"), first["list_ord"] * RANKS).otherwise(0)
    return merged.select(
        "query_id", "parent_id", first["frame_id"].alias("frame_id"),
        F.when(F.col("_fuse"), total).otherwise(first["score"]).alias("score"), arrival.alias("pos"))


def rrf(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion by parent chunk.

    Pages of one parent add up, the first hit stands for the parent, hits
    without an id stay apart.
    """
    return _merge(_listed(lexical, semantic), F.lit(True), k)


def dispatch(requests: DataFrame, lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Candidates of each request by its search mode; unknown modes are lexical.

    Each list is read once: rows of fused requests merge by parent, the others
    pass through.
    """
    mode = F.lower("search_mode")
    listed = _listed(lexical, semantic).join(requests.select("query_id", mode.alias("_mode")), "query_id")
    wanted = (F.col("_mode") == "rrf") | (F.col("list_ord") == F.when(F.col("_mode") == "sem", 1).otherwise(0))
    merged = _merge(listed.where(wanted), F.col("_mode") == "rrf", RRF_K)
    return merged.select("query_id", "frame_id", "score", "pos")


def fetch_errors(requests: DataFrame, query_vecs: DataFrame) -> DataFrame:
    """Requests that need a query vector and have none: an error and no hits."""
    needs = requests.where(F.lower("search_mode").isin("sem", "rrf"))
    return needs.join(query_vecs.select("query_id"), "query_id", "left_anti").select(
        "query_id",
        F.format_string("fetch error (%s): no query vector", F.lower("search_mode")).alias("error"),
    )
