"""Search over a primary and a secondary corpus."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import start_trail
from ..operators import guardrails as g
from ..operators import rerank as r
from ..operators.fusion import fetch_errors
from ..rules import FEDERATED
from ..rules import vocabulary as v
from ..session import stored
from .search import Corpus, candidates, understood

def _mode():
    return F.lower("source_mode")


def failover_threshold():
    """Score below which the secondary corpus is asked; the request's own only for unknown modes."""
    branch = F
    for mode, limit in v.FAILOVER_THRESHOLDS.items():
        branch = branch.when(F.lower("search_mode") == mode, F.lit(limit))
    return branch.otherwise(F.col("who_failover_threshold"))


def secondary_requests(intents: DataFrame, primary: DataFrame) -> DataFrame:
    """Requests that go to the secondary corpus, with the k that applies there."""
    seen = primary.groupBy("query_id").agg(
        F.count("*").cast("int").alias("n_primary"), F.max_by("score", -F.col("pos")).alias("top_primary"))
    joined = intents.join(seen, "query_id", "left").withColumn("n_primary", F.coalesce("n_primary", F.lit(0)))
    low = F.col("top_primary").isNull() | (F.col("top_primary") < failover_threshold())
    gap = F.col("k") - F.col("n_primary")
    asked = (
        F.when(_mode() == "who", gap > 0).when(_mode() == "wiki", True)
        .when(F.col("who_first_policy"), low).otherwise(True)
    )
    out = joined.where(asked)
    return out.withColumns({
        "k": F.when(_mode() == "who", gap).otherwise(F.col("k")),
        "strict_cds_mode": (_mode() != "who") & F.col("strict_cds_mode"),
        "failover_reason": F.when(
            ~_mode().isin("who", "wiki") & F.col("who_first_policy"),
            F.when(F.col("n_primary") == 0, "who_no_hit").otherwise("who_low_score")),
    })


def merge_sources(intents: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Hits of both corpora in order.

    Mode who lists the primary first; the automatic modes sort the union by
    score and keep k; mode wiki has only the secondary.
    """
    both = primary.withColumn("side", F.lit(0)).unionByName(secondary.withColumn("side", F.lit(1)))
    slots = intents.select("query_id", "source_mode", "who_first_policy", F.col("k").alias("k_asked"),
                           F.col("strict_cds_mode").alias("strict_asked"))
    both = both.drop("k", "strict_cds_mode").join(slots, "query_id")
    auto = ~_mode().isin("who", "wiki")
    order = Window.partitionBy("query_id").orderBy(F.when(auto, -F.col("score")), "side", "pos")
    merged = both.withColumn("side_pos", F.col("pos")).withColumn("pos", F.row_number().over(order))
    merged = merged.withColumnRenamed("k_asked", "k").withColumnRenamed("strict_asked", "strict_cds_mode")
    return start_trail(merged.where(~auto | (F.col("pos") <= F.col("k"))))


def chosen_hit(intents: DataFrame, primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The hit a policy settles on before reranking: query_id, chosen (struct), with its score."""
    key = F.struct(-F.col("pos"))
    top = lambda hits, name: hits.groupBy("query_id").agg(
        F.max_by(F.struct("frame_id", "source", "score"), key).alias(name))
    joined = intents.join(top(primary, "p"), "query_id", "left").join(top(secondary, "s"), "query_id", "left")
    either = F.coalesce("p", "s")
    better = F.when(F.col("s.score") > F.col("p.score"), F.col("s")).otherwise(either)
    enough = F.coalesce(F.col("p.score") >= failover_threshold(), F.lit(False))
    chosen = (
        F.when(_mode() == "who", F.col("p")).when(_mode() == "wiki", F.col("s"))
        .when(~F.col("who_first_policy"), better)
        .when(enough, F.col("p")).otherwise(F.coalesce("s", "p"))
    )
    return joined.select("query_id", chosen.alias("chosen"))


def federated_hits(intents: DataFrame, primary: Corpus, secondary: Corpus, query_vecs: DataFrame):
    """(final hits, primary hits, secondary hits, secondary requests) of all requests.

    Hits of either side are at most a pool per request; they are stored, as several results derive from them.
    """
    pack = FEDERATED
    first = intents.where(_mode() != "wiki")
    p = stored(r.score_candidates(candidates(first, primary, query_vecs, pack), pack))
    asked = stored(secondary_requests(intents, p))
    s = stored(r.score_candidates(candidates(asked, secondary, query_vecs, pack), pack))
    merged = merge_sources(intents, p, s)
    floor = F.when(~F.col("strict_cds_mode") & F.col("is_action"), pack.action_floor).otherwise(F.col("threshold"))
    kept = settle_positions(r.apply_threshold(merged, floor))
    return r.intent_rerank(kept, pack), p, s, asked


def settle_positions(hits: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("pos")
    return hits.withColumn("pos", F.row_number().over(order))


def federated_search(requests: DataFrame, primary: Corpus, secondary: Corpus, query_vecs: DataFrame) -> DataFrame:
    """One response per request, blank ones with an error: hits, hit, source_used, secondary count, failover reason, flags."""
    pack = FEDERATED
    intents = understood(requests, pack)
    hits, p, s, asked = federated_hits(intents, primary, secondary, query_vecs)
    hits = hits.withColumns({"rescued": F.lit(False)})
    flags = g.quality_flags(hits, pack)
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("pos").alias("rank"), "score", "frame_id", "source", "title", "content", "uri", "content_type"))).alias("hits"))
    floor = F.when(~F.col("strict_cds_mode") & F.col("is_action"), pack.action_floor).otherwise(F.col("threshold"))
    chosen = chosen_hit(intents, p, s)
    # each side that is asked and cannot be reports its own error, the primary first
    failed = fetch_errors(intents.where(_mode() != "wiki"), query_vecs).unionByName(fetch_errors(asked, query_vecs))
    errors = failed.groupBy("query_id").agg(F.collect_list("error").alias("errors"))
    joined = (
        intents.join(lists, "query_id", "left").join(flags, "query_id", "left").join(chosen, "query_id", "left")
        .join(asked.select("query_id", "failover_reason"), "query_id", "left").join(errors, "query_id", "left")
    )
    strings = F.array().cast("array<string>")
    no_hit = F.col("strict_cds_mode") & F.col("hits").isNull() & F.col("is_action")
    flagged = F.concat(F.coalesce("quality_flags", strings), F.when(no_hit, F.array(F.lit("strict_cds_no_hit"))).otherwise(strings))
    empty = F.array().cast(lists.schema["hits"].dataType)
    joined = joined.withColumn("quality_flags", flagged)
    zeroed = F.col("strict_mode") & (F.size("quality_flags") > 0)
    joined = joined.withColumn("hits", F.when(zeroed, empty).otherwise(F.coalesce("hits", empty)))
    own = F.when(~zeroed & ((floor <= 0) | (F.col("chosen.score") >= floor)), F.col("chosen"))
    first = F.try_element_at("hits", F.lit(1))
    fallback = F.when(first.isNotNull(), F.struct(first["frame_id"].alias("frame_id"), first["source"].alias("source"), first["score"].alias("score")))
    hit = F.coalesce(own, fallback)
    answered = joined.select(
        "query_id", "query", hit.alias("hit"), F.coalesce(hit["source"], F.lit("none")).alias("source_used"), "hits",
        F.size(F.filter("hits", lambda h: h["source"] == v.SECONDARY_SOURCE)).alias("secondary_count"),
        "failover_reason", F.coalesce("errors", strings).alias("errors"), "quality_flags",
    )
    blank = {"hit": F.lit(None), "source_used": F.lit("none"), "hits": empty, "secondary_count": F.lit(0), "failover_reason": F.lit(None),
             "errors": F.array("error"), "quality_flags": strings}
    invalid = requests.where(F.col("error").isNotNull()).select(
        "query_id", "query", *[c.cast(answered.schema[n].dataType).alias(n) for n, c in blank.items()])
    return answered.unionByName(invalid)


