"""Positional guardrails, trimming, quality flags and response assembly."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import head, matches
from ..rules import RulePack, V2
from ..rules import vocabulary as v
from .rerank import actionable, is_in
from .signals import LOWER, PLAIN

# fixed values: guardrail ratio, flag limits, reasons
GUARD_RATIO, LOW_CONFIDENCE, LOW_PRIORITY = 0.70, 0.012, 0.5
ALIGNED_REASON = "always_on_guardrail_aligned_swap"
OFF_CONDITION_REASON = "off_condition_top_replaced_by_aligned_candidate"

def _plain() -> Column:
    return F.concat(F.col("title"), F.lit(" "), head(F.col("content"), 1200))


def _per_query():
    return Window.partitionBy("query_id")


def _of_top(value: Column) -> Column:
    """Value of the hit at position 1, on every hit of the query."""
    return F.max(F.when(F.col("pos") == 1, value)).over(_per_query())


def _swap(hits: DataFrame, wanted: Column, flag: str) -> DataFrame:
    """Move the first wanted hit to position 1; scores stay."""
    hits = hits.withColumn("_from", F.min(F.when(wanted, F.col("pos"))).over(_per_query()))
    pos, start = F.col("pos"), F.col("_from")
    moved = F.when(pos == start, 1).when(pos < start, pos + 1).otherwise(pos)
    return hits.withColumn("pos", moved).withColumn(flag, start.isNotNull()).drop("_from")


def promote_aligned(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Put the first strong, on-topic alternative on top of an off-topic hit.

    v2 never displaces an actionable top hit, promotes only actionable hits, and
    for action queries replaces even an on-topic top hit that is not actionable.
    """
    aligned = F.when(
        F.col("condition").isNotNull(), F.col(f"{LOWER}.on") & ~F.col(f"{LOWER}.off")
    ).otherwise(F.col(f"{PLAIN}.coherent"))
    hits = hits.withColumns({"aligned": aligned, "promotable": is_in(pack.action_types) | F.col("rescued")})
    strong = F.col("score") >= _of_top(F.col("score")) * pack.promote_ratio
    wanted = (F.col("pos") > 1) & F.col("aligned") & strong
    if pack.guarded_promotion:
        wanted = (
            wanted & F.col("promotable") & ~_of_top(F.col("promotable"))
            & (~_of_top(F.col("aligned")) | F.col("is_action"))
        )
    else:
        wanted = wanted & ~_of_top(F.col("aligned"))
    return _swap(hits.withColumn("_wanted", wanted), F.col("_wanted"), "aligned_swap").drop("_wanted")


def _off_condition(pack: RulePack, top_actionable: Column) -> Column:
    off = ~F.col(f"{PLAIN}.on") & ((F.size("coherence") == 0) | ~F.col(f"{PLAIN}.coherent"))
    if pack.chest_syndrome:
        off = off | (F.col("asks_chest_syndrome") & ~matches(_plain(), v.CHEST_SYNDROME_CHUNK))
    return F.col("condition").isNotNull() & off & ~(F.col("asks_component") & top_actionable)


def safe_top(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Optional strict guardrail of requests that ask for it."""
    component = is_in(pack.component_types) if pack.component_types else is_in(pack.action_types)
    hits = hits.withColumns({
        "_off": _off_condition(pack, component),
        "_fits": F.col(f"{PLAIN}.on") & ((F.size("coherence") == 0) | F.col(f"{PLAIN}.coherent")),
    })
    wanted = (
        F.col("safe_top1_guardrail") & (F.col("pos") > 1) & _of_top(F.col("_off")) & F.col("_fits")
        & (~F.col("is_action") | is_in(pack.action_types))
        & (F.col("score") >= _of_top(F.col("score")) * GUARD_RATIO)
    )
    if pack.same_source_guard:
        wanted = wanted & (F.col("source") == _of_top(F.col("source")))
    hits = _swap(hits.withColumn("_wanted", wanted), F.col("_wanted"), "safe_swap")
    return hits.drop("_wanted", "_off", "_fits")


def trim(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("pos") <= F.col("k"))


def quality_flags(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """query_id, quality_flags: what a caller should distrust in the final hits."""
    top, top3 = F.col("pos") == 1, F.col("pos") <= 3
    if pack.guarded_promotion:  # current generation
        acts = actionable(pack) | F.col("rescued")
        checks = [
            ("corruption_in_top3", F.max(top3 & F.col("_corrupt"))),
            ("low_confidence", F.max(top & (F.col("score") < LOW_CONFIDENCE))),
            ("off_condition_top", F.max(top & F.col("_off"))),
            ("no_actionable_in_top3", F.max("is_action") & ~F.max(top3 & F.col("_acts"))),
            ("low_priority_top", F.max(top & (F.col("retrieval_priority") < LOW_PRIORITY))),
        ]
        top_acts = acts
    else:
        acts = actionable(pack) if pack.protocol_bonus else is_in(pack.action_types)
        top_acts = is_in(pack.component_types)
        checks = [("corruption_in_top3", F.max(top3 & F.col("_corrupt")))]
        if pack.promotion:
            checks += [
                ("low_confidence_all_results", F.max(top & (F.col("score") < LOW_CONFIDENCE))),
                ("off_condition_top_result", F.max(top & F.col("_off"))),
            ]
        checks.append(("no_protocol_in_top3", F.max("is_action") & ~F.max(top3 & F.col("_acts"))))
    seen = hits.withColumns({
        "_corrupt": matches(head(F.col("content"), 300), pack.corruption),
        "_off": _off_condition(pack, top_acts),
        "_acts": acts,
    })
    found = seen.groupBy("query_id").agg(
        F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks])).alias("quality_flags")
    )
    return found


RESPONSE_HIT = [
    "rank", "score", "title", "content", "source", "uri", "frame_id", "content_type",
    "retrieval_priority", "is_current", "headings", "doc_type", "recommendation_strength",
    "evidence_certainty", "source_url", "pdf_file",
]


def assemble(requests: DataFrame, hits: DataFrame, flags: DataFrame, errors: DataFrame,
             pack: RulePack = V2) -> DataFrame:
    """One response row per request; requests without hits keep an empty list."""
    struct = F.struct(F.col("pos").alias("rank"), *RESPONSE_HIT[1:])
    lists = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(struct)).alias("hits"),
        F.max("aligned_swap").alias("aligned_swap"),
        F.max("safe_swap").alias("safe_swap"),
    )
    none = F.lit(False)
    out = (
        requests.select("query_id", "query", "is_action", "strict_mode", "strict_cds_mode")
        .join(lists, "query_id", "left")
        .join(flags, "query_id", "left")
        .join(errors.groupBy("query_id").agg(F.array_sort(F.collect_list("error")).alias("errors")), "query_id", "left")
    )
    strings = F.array().cast("array<string>")
    aligned, safe = F.coalesce("aligned_swap", none), F.coalesce("safe_swap", none)
    flagged = F.coalesce("quality_flags", strings)
    if not pack.guarded_promotion:
        no_hit = F.col("strict_cds_mode") & F.col("hits").isNull() & F.col("is_action")
        flagged = F.concat(flagged, F.when(no_hit, F.array(F.lit("strict_cds_no_hit"))).otherwise(strings))
    out = out.withColumn("quality_flags", flagged)
    hit_type = lists.schema["hits"].dataType
    empty = F.array().cast(hit_type)
    kept = F.coalesce("hits", empty)
    if not pack.guarded_promotion:
        kept = F.when(F.col("strict_mode") & (F.size("quality_flags") > 0), empty).otherwise(kept)
        swapped, reason = safe, F.when(safe, OFF_CONDITION_REASON)
    else:
        swapped = aligned | safe
        reason = F.when(safe, OFF_CONDITION_REASON).when(aligned, ALIGNED_REASON)
    out = out.withColumn("hits", kept)
    return out.select(
        "query_id", "query", F.try_element_at("hits", F.lit(1)).alias("hit"), "hits",
        F.coalesce("errors", strings).alias("errors"), "quality_flags",
        swapped.alias("top1_swapped"), reason.alias("top1_swap_reason"),
    )
