"""Query understanding: synonym expansion and intent slots (map-only)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches, quote, strip
from ..rules import RulePack, V2
from ..rules import vocabulary as v
from .signals import bit


def expand_query(query: Column, pack: RulePack) -> Column:
    """Query followed by the sorted synonyms of its terms that it does not hold yet."""
    nothing = F.array().cast("array<string>")
    found = [
        F.when(matches(query, rf"\b{quote(term)}\b"), F.array(*map(F.lit, names))).otherwise(nothing)
        for term, names in pack.synonyms
    ]
    new = F.filter(
        F.array_distinct(F.concat(*found)), lambda a: ~F.contains(F.lower(query), F.lower(a))
    )
    return F.when(
        F.size(new) > 0, strip(F.concat_ws(" ", query, F.array_join(F.array_sort(new), " ")))
    ).otherwise(query)


def action_query(query: Column, pack: RulePack) -> Column:
    dose, topic = matches(query, pack.action_dose), matches(query, pack.action_condition)
    if pack.action_needs_dose:
        return dose & topic
    return topic & (dose | matches(query, v.ACTION_TASK))


def first_topic(query: Column, pack: RulePack) -> Column:
    return F.coalesce(*[F.when(matches(query, q), cid) for cid, q, _, _ in pack.conditions])


def topic_bit(condition: Column, pack: RulePack) -> Column:
    """Bit of a condition in its pack; 0 if there is none."""
    branch = F
    for k, rule in enumerate(pack.conditions):
        branch = branch.when(condition == rule[0], bit(k))
    return branch.otherwise(F.lit(0).cast("bigint"))


def active_rules(query: Column, rules) -> Column:
    """All rules whose query pattern matches: array of (id, bit, factor)."""
    found = [
        F.when(matches(query, rule[1]), F.struct(
            F.lit(rule[0]).alias("id"), bit(k).alias("bit"), F.lit(rule[3] if len(rule) > 3 else 1.0).alias("factor")))
        for k, rule in enumerate(rules)
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast(_RULES)


_RULES = "array<struct<id:string,bit:bigint,factor:double>>"


def query_intent(queries: DataFrame, pack: RulePack = V2) -> DataFrame:
    """Requests with the expanded query and its intent slots.

    The given query stays as ``asked``; every slot is read from the expanded one.
    """
    asked = queries.withColumn("asked", F.col("query")).withColumn("query", expand_query(F.col("query"), pack))
    q = F.col("query")
    slots = asked.withColumns({
        "is_action": action_query(q, pack),
        "condition": first_topic(q, pack),
        "coherence": active_rules(q, pack.coherence),
        "title_exclusions": active_rules(q, (*pack.title_exclusions, *pack.title_overrides)),
        "content_exclusions": active_rules(q, pack.content_exclusions),
        "sev_light": matches(q, v.SEVERITY_LIGHT_QUERY),
        "_heavy": matches(q, v.SEVERITY_HEAVY_QUERY),
        "sensitive_tb": matches(q, v.SENSITIVE_TB_QUERY),
        "pop_adult": matches(q, v.POP_ADULT_QUERY),
        "pop_neonate": matches(q, v.POP_NEONATE_QUERY),
        "_child": matches(q, v.POP_CHILD_QUERY),
        "task": F.coalesce(*[F.when(matches(q, p), t) for t, p in v.TASKS]),
        "asks_chest_syndrome": matches(q, v.CHEST_SYNDROME_QUERY),
        "asks_component": matches(q, pack.treatment_component),
        "asks_paediatric": matches(q, v.PAEDIATRIC_QUERY),
        "asks_adult_other": matches(q, v.ADULT_NON_OBSTETRIC) & ~matches(q, v.OBSTETRIC_QUERY),
    })
    return slots.withColumns({
        "sev_heavy": F.col("_heavy") & ~F.col("sev_light"),
        "pop_child": F.col("_child") & ~F.col("pop_adult") & ~F.col("pop_neonate"),
        "topic": topic_bit(F.col("condition"), pack),
    }).drop("_heavy", "_child")


INTENT_COLUMNS = [
    "is_action", "condition", "coherence", "title_exclusions", "content_exclusions", "topic", "sev_light", "sev_heavy", "sensitive_tb", "pop_adult", "pop_neonate", "pop_child",
    "task", "asks_chest_syndrome", "asks_component", "asks_paediatric", "asks_adult_other",
]
