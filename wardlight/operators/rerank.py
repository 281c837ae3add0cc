"""Rule-based reranking of search candidates.

All stages work on one row per (query_id, candidate), joined to the query's
intent columns and hash-partitioned by query_id, so that the windows below share
that one shuffle.  A query has at most a few dozen candidates.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import by_trail, factor, rescored, settle, start_trail
from ..functions.text import head, matches, strip
from ..rules import RulePack, V2
from ..rules import vocabulary as v
from .signals import BOTH, HEAD, PLAIN, RESCUE, TITLE

# fixed values: stage factors
CONTEXT_FACTOR, SIGNAL_STEP, ACTION_BONUS, PROTOCOL_BONUS = 0.75, 0.07, 1.15, 1.08
PAEDIATRIC_FACTOR, OBSTETRIC_FACTOR = 0.55, 0.60
INCOHERENT_FACTOR, RESCUE_FACTOR, SOFT_CORRUPTION_FACTOR = 0.65, 3.0, 0.45
WEAK_TITLE_FACTOR, HEADING_FACTOR, HEADING_CHARS = 0.60, 0.35, 320
PER_FILE, CROWDED_FACTOR = 2, 0.50
EVIDENCE_FLOOR, TAIL_KEEP, TAIL_RATIO = 0.08, 4, 0.30
PENALTY_FLOOR, RELAX = 0.10, 0.50 / 0.35

def _content() -> Column:
    return F.col("content")


def _title() -> Column:
    return F.col("title")


def _type() -> Column:
    return F.col("content_type")


def _with_title(n: int) -> Column:
    return F.concat(_title(), F.lit(" "), head(_content(), n))


def _protocol_window() -> Column:
    return head(F.concat(_title(), F.lit("\n"), _content()), 2000)


def is_in(values) -> Column:
    return _type().isin(*values) if values else F.lit(False)


def signal_count(text: Column) -> Column:
    found = [matches(text, p).cast("int") for p in (v.DOSE_NUMBER, v.ROUTE_ADMIN, v.FREQUENCY)]
    return found[0] + found[1] + found[2]


def drop_corrupted(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    return hits.where(~matches(head(_content(), 2000), pack.corruption))


def drop_superseded(hits: DataFrame) -> DataFrame:
    return hits.where((F.col("retrieval_priority") > 0) & ~F.isnan("retrieval_priority"))


def boost_types(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Score times the weight of the content type (and, in v2, the chunk's priority)."""
    weights = F.create_map(*[F.lit(x) for pair in pack.type_weights.items() for x in pair])
    score = F.col("score") * F.coalesce(F.try_element_at(weights, _type()), F.lit(1.0))
    if pack.metadata_priority:
        return rescored(hits, score * F.col("retrieval_priority"))
    title = strip(_title())
    score = score * factor((_type() == "regular") & (_title() != "") & matches(title, v.WEAK_TITLE_V1), WEAK_TITLE_FACTOR)
    if pack.heading_fragments:
        body = strip(_content())
        fragment = (
            (title != "") & matches(title, v.BARE_HEADING_V1)
            & ~matches(head(body, 1200), v.PROTOCOL_TEXT) & (F.length(body) < HEADING_CHARS)
        )
        score = score * factor(fragment, HEADING_FACTOR)
    return rescored(hits, score)


def actionable(pack: RulePack) -> Column:
    return is_in(pack.action_types) | matches(_protocol_window(), v.PROTOCOL_TEXT)


def boost_actions(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Action queries: demote context, reward dose, route and frequency text and action types."""
    asked = F.col("is_action")
    signals = F.lit(1.0) + F.lit(SIGNAL_STEP) * signal_count(head(_content(), 2000))
    steps = [
        F.when(is_in(pack.context_types), CONTEXT_FACTOR).otherwise(1.0),
        signals,
        F.when(is_in(pack.action_types), ACTION_BONUS).otherwise(1.0),
    ]
    if pack.protocol_bonus:
        steps.append(F.when(actionable(pack), PROTOCOL_BONUS).otherwise(1.0))
    if pack.metadata_priority:
        score = F.col("score")
        for step in steps:
            score = score * step
        return rescored(hits, F.when(asked, score).otherwise(F.col("score")))
    for step in steps:  # the first generation re-sorts after every step
        hits = rescored(hits, F.when(asked, F.col("score") * step).otherwise(F.col("score")))
    return hits


def evidence_floor(hits: DataFrame) -> DataFrame:
    weak = F.col("is_action") & is_in(v.EVIDENCE_TYPES_V1) & (F.col("score") < EVIDENCE_FLOOR)
    return hits.where(~weak)


def demote_population(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    child = F.col("pdf_file").isin(*pack.paediatric_files) if pack.paediatric_files else F.lit(False)
    obstetric = F.col("asks_adult_other") & F.col("pdf_file").isin(*v.OBSTETRIC_FILES)
    score = F.col("score") * factor(child, PAEDIATRIC_FACTOR) * factor(obstetric, OBSTETRIC_FACTOR)
    return rescored(hits, F.when(F.col("asks_paediatric"), F.col("score")).otherwise(score))


def demote_incoherent(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Chunks without a word of any topic that the query names."""
    off = (F.size("coherence") > 0) & ~F.col(f"{HEAD}.coherent")
    harsh = F.when(is_in(pack.action_types), pack.harsh_incoherence).otherwise(INCOHERENT_FACTOR)
    return rescored(hits, F.when(off, F.col("score") * harsh).otherwise(F.col("score")))


def _exclusions(rules: str, window: str) -> Column:
    """Score times the factor of every active rule that the window's text matches, in rule order."""
    found = F.col(f"{window}.rules")
    return F.aggregate(rules, F.col("score"), lambda acc, r: acc * F.when(found.bitwiseAND(r["bit"]) != 0, r["factor"]).otherwise(1.0))


def demote_exclusions(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Chunks about a disease that is known to be confused with the query's."""
    by_title = _exclusions("title_exclusions", TITLE)
    if pack.metadata_priority:
        return rescored(hits.withColumn("score", by_title), _exclusions("content_exclusions", PLAIN))
    hits = rescored(hits, by_title)
    if not pack.content_exclusions:
        return hits
    return rescored(hits, _exclusions("content_exclusions", PLAIN))


def rescue_background(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Background chunks that read like a protocol for the query's topic."""
    if not pack.rescue:
        return hits.withColumn("rescued", F.lit(False))
    protocol = matches(_protocol_window(), v.PROTOCOL_TEXT) & (
        matches(_protocol_window(), v.RESCUE_RECOMMEND) | (signal_count(_protocol_window()) >= 2)
    )
    # an off-topic chunk is rescued only if it is on topic as well, which is the plain on-topic test
    on_topic = F.coalesce(F.when(F.col("condition").isNotNull(), F.col(f"{RESCUE}.on")).otherwise(F.col(f"{RESCUE}.coherent")), F.lit(False))
    hits = hits.withColumn("rescued", (_type() == "background") & protocol & on_topic)
    return rescored(hits, F.col("score") * factor(F.col("rescued"), RESCUE_FACTOR))


def demote_soft_corruption(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    if not pack.soft_corruption:
        return hits
    noisy = matches(_with_title(1200), v.CORRUPTION_SOFT)
    return rescored(hits, F.col("score") * factor(noisy, SOFT_CORRUPTION_FACTOR))


def diversify(hits: DataFrame) -> DataFrame:
    """Halve the third and later hit of one file."""
    place = F.row_number().over(by_trail("query_id", "pdf_file"))
    hits = hits.withColumn("file_place", place)
    return rescored(hits, F.col("score") * factor(F.col("file_place") > PER_FILE, CROWDED_FACTOR))


def trim_tail(hits: DataFrame) -> DataFrame:
    """Action queries: keep four hits, then only those near the top; strict: only those near the top."""
    near = F.col("score") >= F.max("score").over(Window.partitionBy("query_id")) * TAIL_RATIO
    kept = ~F.col("is_action") | near | (~F.col("strict_cds_mode") & (F.col("pos") <= TAIL_KEEP))
    return hits.withColumn("_kept", kept).where("_kept").drop("_kept")


def strict_types(hits: DataFrame, pack: RulePack) -> DataFrame:
    """Strict requests: action types only, no generic or garbled titles."""
    blocked = (_title() != "") & (matches(_title(), pack.corruption) | matches(strip(_title()), v.WEAK_TITLE_V1))
    allowed = is_in(v.STRICT_TYPES_V1) & ~blocked
    return hits.where(~F.col("strict_cds_mode") | allowed)


def score_candidates(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """All stages up to the source diversity cap; hits come back with a settled ``pos``."""
    hits = start_trail(drop_corrupted(hits, pack))
    if pack.metadata_priority:
        hits = drop_superseded(hits)
    hits = boost_actions(boost_types(hits, pack), pack)
    if not pack.metadata_priority:
        hits = evidence_floor(hits)
    hits = demote_exclusions(demote_incoherent(demote_population(hits, pack), pack), pack)
    hits = demote_soft_corruption(rescue_background(hits, pack), pack)
    hits = settle(diversify(hits))
    if not pack.metadata_priority:
        hits = settle(strict_types(trim_tail(hits), pack))
        hits = hits.where(F.col("pos") <= F.col("k"))
    return hits


def apply_threshold(hits: DataFrame, floor: Column) -> DataFrame:
    return hits.where((floor <= 0) | (F.col("score") >= floor))


def intent_signals(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Chunk-side slot flags, each computed only where the query asks for it."""
    both = F.concat(F.lower(strip(_title())), F.lit(" "), F.lower(_content()))
    hits = hits.withColumn("both", both)
    text = F.col("both")
    only = lambda asked, pattern: asked & matches(text, pattern)
    severity = F.col("sev_light") | F.col("sev_heavy")
    adult, neonate, child = F.col("pop_adult"), F.col("pop_neonate"), F.col("pop_child")
    return hits.withColumns({
        "on_topic": F.col(f"{BOTH}.on"),
        "off_topic": F.col(f"{BOTH}.off"),
        "chunk_heavy": only(severity, v.SEVERITY_HEAVY_CHUNK),
        "chunk_light": only(F.col("sev_light"), v.SEVERITY_LIGHT_CHUNK),
        "chunk_resistant": only(F.col("sensitive_tb"), v.RESISTANT_TB_CHUNK),
        "chunk_neonate": only(adult | neonate | child, v.POP_NEONATE_CHUNK),
        "chunk_child": only(adult | child, v.POP_CHILD_CHUNK),
        "chunk_adult": only(adult, v.POP_ADULT_CHUNK),
        "chunk_scorpion": only(F.col("condition") == "snakebite", v.SCORPION_CHUNK),
        "chunk_rabies_confuser": only(F.col("condition") == "rabies", v.RABIES_CONFUSERS),
        "chest_miss": (F.col("condition") == "sickle_cell") & F.col("asks_chest_syndrome")
        & ~matches(text, v.CHEST_SYNDROME_CHUNK),
        "incoherent": (F.size("coherence") > 0) & ~F.col(f"{BOTH}.coherent"),
    }).withColumns({
        c: F.coalesce(c, F.lit(False)) for c in ("chunk_scorpion", "chunk_rabies_confuser", "chest_miss")
    })


def _penalty(pack: RulePack) -> Column:
    c = F.col
    asked = c("condition").isNotNull()
    on, off = c("on_topic"), c("off_topic")
    p = F.lit(1.0)
    if pack.type_penalties:
        p = p * F.when(_type() == "annex", 0.25).when(_type() == "research_gap", 0.15).when(
            _type().isin("scope", "executive_summary"), 0.35).otherwise(1.0)
    if pack.annex_titles:
        p = p * factor(matches(strip(_title()), v.ANNEX_TITLE_V1), 0.25)
    topic = F.when(~asked, 1.0).when(off & ~on, pack.off_topic_penalty)
    if pack.mixed_topic_penalty is not None:
        topic = topic.when(off & on, pack.mixed_topic_penalty)
    topic = topic.when(on, 1.0)
    p = p * topic.otherwise(pack.neither_topic_penalty or 1.0)
    if pack.topic_overrides:
        p = p * factor(c("chunk_scorpion"), 0.05) * factor(c("chunk_rabies_confuser"), 0.20)
    if pack.chest_syndrome:
        p = p * factor(c("chest_miss"), 0.30)
    if pack.generic_titles:
        p = p * factor(asked & ~on & matches(strip(_title()), v.GENERIC_TITLE_V1), 0.45)
        p = p * factor(asked & ~on & matches(strip(_title()), v.NOISE_TITLE_V1), 0.35)
    if pack.type_penalties:
        weak = asked & ~on
        p = p * F.when(weak & _type().isin("background", "methods_pico", "methodology", "epidemiology"), 0.45).when(
            weak & _type().isin("evidence_summary", "etd", "rationale", "remarks"), 0.55).otherwise(1.0)
        p = p * factor(asked & on & c("incoherent"), 0.55)
    p = p * factor(c("sev_light") & c("chunk_heavy"), 0.35)
    p = p * factor(c("sensitive_tb") & c("chunk_resistant"), 0.25)
    p = p * F.when(c("pop_adult") & c("chunk_neonate"), 0.30).when(
        c("pop_adult") & c("chunk_child") & ~c("chunk_adult"), 0.60).otherwise(1.0)
    return F.greatest(p, F.lit(PENALTY_FLOOR))


def _bonuses(pack: RulePack) -> list[tuple[Column, float]]:
    """(slot matched, boost) in the order the boosts add up."""
    c = F.col
    topic = c("condition").isNotNull() & c("on_topic")
    if pack.mixed_topic_penalty is not None:
        topic = topic & ~c("off_topic")
    if pack.topic_overrides:
        topic = topic & ~c("chunk_scorpion")
    if pack.chest_syndrome:
        topic = topic & ~c("chest_miss")
    severity = (c("sev_light") & ~c("chunk_heavy") & c("chunk_light")) | (
        ~c("sev_light") & c("sev_heavy") & c("chunk_heavy"))
    adult = c("pop_adult") & ~c("chunk_neonate") & c("chunk_adult")
    neonate = ~c("pop_adult") & c("pop_neonate") & c("chunk_neonate")
    child = ~c("pop_adult") & ~c("pop_neonate") & c("pop_child") & c("chunk_child") & ~c("chunk_neonate")
    wanted = F.lit(False)
    for task, types in pack.task_types.items():
        wanted = wanted | ((c("task") == task) & _type().isin(*types))
    return [(topic, 0.25), (severity, 0.10), (adult, 0.10), (neonate, 0.20), (child, 0.10),
            (F.coalesce(wanted, F.lit(False)), 0.10)]


def intent_scores(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Add penalty, boost, slots and ``adjusted`` = score x penalty x (1 + boost)."""
    boost, slots = F.lit(0.0), F.lit(0)
    for matched, gain in _bonuses(pack):
        boost = boost + F.when(matched, F.lit(gain)).otherwise(0.0)
        slots = slots + matched.cast("int")
    hits = hits.withColumns({"penalty": _penalty(pack), "boost": boost, "slots": slots})
    more = F.when(F.col("slots") >= 3, 0.15).when(F.col("slots") == 2, 0.05).otherwise(0.0)
    hits = hits.withColumn("boost", F.col("boost") + more)
    return hits.withColumn("adjusted", F.col("score") * F.col("penalty") * (1.0 + F.col("boost")))


def relax_light(hits: DataFrame) -> DataFrame:
    """Light-severity queries whose on-topic hits are all severe: soften the best of them."""
    asked = F.col("sev_light") & F.col("condition").isNotNull() & F.col("on_topic")
    per_query = Window.partitionBy("query_id")
    has_light = F.max(asked & F.col("chunk_light")).over(per_query)
    best = F.row_number().over(
        Window.partitionBy("query_id", "_asked").orderBy(F.col("adjusted").desc(), F.col("pos"))
    )
    hits = hits.withColumn("_asked", asked).withColumn("relaxed", F.col("_asked") & ~has_light & (best == 1))
    return hits.withColumn("adjusted", F.col("adjusted") * factor(F.col("relaxed"), RELAX)).drop("_asked")


def intent_rerank(hits: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Rerank by intent; comes back with the adjusted score and a settled ``pos``.

    The federated profile orders by the adjusted score but keeps the old one.
    """
    hits = intent_scores(intent_signals(hits, pack), pack)
    if pack.light_guard:
        hits = relax_light(hits)
    else:
        hits = hits.withColumn("relaxed", F.lit(False))
    before = F.col("score")
    hits = hits.withColumn("trail", F.concat(F.array("adjusted"), "trail"))
    hits = hits.withColumn("pos", F.row_number().over(by_trail("query_id")))
    return start_trail(hits.withColumn("score", F.col("adjusted") if pack.rescored else before))
