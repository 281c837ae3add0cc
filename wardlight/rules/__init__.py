"""Rule packs: which vocabulary and which switches a search profile uses."""

from dataclasses import dataclass

from . import vocabulary as v


@dataclass(frozen=True)
class RulePack:
    name: str
    conditions: tuple
    coherence: tuple
    title_exclusions: tuple
    title_overrides: tuple
    content_exclusions: tuple
    synonyms: tuple
    type_weights: dict
    default_type: str
    action_types: tuple
    context_types: tuple
    task_types: dict
    action_dose: str
    action_condition: str
    action_needs_dose: bool
    corruption: str
    metadata_lines: tuple
    treatment_component: str
    component_types: tuple | None
    paediatric_files: tuple
    promote_ratio: float
    off_topic_penalty: float = 0.12
    mixed_topic_penalty: float | None = 0.55
    neither_topic_penalty: float | None = None
    harsh_incoherence: float = 0.20
    metadata_priority: bool = False
    rescue: bool = False
    soft_corruption: bool = True
    protocol_bonus: bool = True
    topic_overrides: bool = True
    chest_syndrome: bool = False
    type_penalties: bool = False
    annex_titles: bool = False
    generic_titles: bool = False
    heading_fragments: bool = False
    light_guard: bool = True
    promotion: bool = True
    guarded_promotion: bool = False
    same_source_guard: bool = False
    rescored: bool = True
    pool_limit: int | None = 15
    action_floor: float = 0.0


def _conditions(dropped, changes):
    return tuple(
        (cid, *changes[cid]) if cid in changes else (cid, q, on, off)
        for cid, q, on, off in v.CONDITIONS
        if cid not in dropped
    )


V2 = RulePack(
    name="v2",
    conditions=tuple(v.CONDITIONS),
    coherence=tuple(v.COHERENCE),
    title_exclusions=tuple(v.TITLE_EXCLUSIONS),
    title_overrides=tuple(v.TITLE_OVERRIDES),
    content_exclusions=tuple(v.CONTENT_EXCLUSIONS),
    synonyms=tuple(v.SYNONYMS),
    type_weights=v.TYPE_WEIGHTS,
    default_type="background",
    action_types=tuple(v.ACTION_TYPES),
    context_types=tuple(v.CONTEXT_TYPES),
    task_types=v.TASK_TYPES,
    action_dose=v.ACTION_DOSE,
    action_condition=v.ACTION_CONDITION,
    action_needs_dose=False,
    corruption=v.CORRUPTION,
    metadata_lines=tuple(v.METADATA_LINES),
    treatment_component=v.TREATMENT_COMPONENT,
    component_types=None,
    paediatric_files=tuple(v.PAEDIATRIC_FILES),
    promote_ratio=0.70,
    neither_topic_penalty=0.75,
    metadata_priority=True,
    rescue=True,
    chest_syndrome=True,
    type_penalties=True,
    guarded_promotion=True,
)

V1 = RulePack(
    name="v1",
    conditions=_conditions(v.V1_CONDITIONS_DROPPED, v.V1_CONDITION_CHANGES),
    coherence=tuple(c for c in v.COHERENCE if c[0] not in v.V1_COHERENCE_DROPPED),
    title_exclusions=tuple(v.TITLE_EXCLUSIONS),
    title_overrides=tuple(v.TITLE_OVERRIDES),
    content_exclusions=tuple(v.CONTENT_EXCLUSIONS_V1),
    synonyms=tuple(s for s in v.SYNONYMS if s[0] in v.SYNONYM_TERMS_V1),
    type_weights=v.TYPE_WEIGHTS_V1,
    default_type="regular",
    action_types=tuple(v.ACTION_TYPES_V1),
    context_types=tuple(v.CONTEXT_TYPES_V1),
    task_types=v.TASK_TYPES_V1,
    action_dose=v.ACTION_DOSE_V1,
    action_condition=v.ACTION_CONDITION_V1,
    action_needs_dose=False,
    corruption=v.CORRUPTION,
    metadata_lines=tuple(v.METADATA_LINES_V1),
    treatment_component=v.TREATMENT_COMPONENT_V1,
    component_types=tuple(v.COMPONENT_TYPES_V1),
    paediatric_files=tuple(v.PAEDIATRIC_FILES_V1),
    promote_ratio=0.55,
    annex_titles=True,
    generic_titles=True,
    heading_fragments=True,
    same_source_guard=True,
    pool_limit=None,
)

_BY_TOPIC = {c[0]: c for c in (*v.COHERENCE, v.ENVENOMATION_COHERENCE)}

FEDERATED = RulePack(
    name="v1_federated",
    conditions=_conditions(
        v.V1_CONDITIONS_DROPPED + v.FEDERATED_CONDITIONS_DROPPED,
        {**v.V1_CONDITION_CHANGES, **v.FEDERATED_CONDITION_CHANGES},
    ),
    coherence=tuple(_BY_TOPIC[c] for c in v.FEDERATED_COHERENCE),
    title_exclusions=tuple(v.TITLE_EXCLUSIONS[:2]),
    title_overrides=(),
    content_exclusions=(),
    synonyms=V1.synonyms,
    type_weights=v.TYPE_WEIGHTS_V1,
    default_type="regular",
    action_types=tuple(v.ACTION_TYPES_V1),
    context_types=tuple(v.CONTEXT_TYPES_V1),
    task_types=v.TASK_TYPES_V1,
    action_dose=v.ACTION_DOSE_V1,
    action_condition=v.ACTION_CONDITION_V1,
    action_needs_dose=True,
    corruption=v.CORRUPTION_FEDERATED,
    metadata_lines=tuple(v.METADATA_LINES_V1),
    treatment_component=v.TREATMENT_COMPONENT_V1,
    component_types=tuple(v.COMPONENT_TYPES_V1),
    paediatric_files=tuple(v.PAEDIATRIC_FILES_V1),
    promote_ratio=0.55,
    off_topic_penalty=0.25,
    mixed_topic_penalty=None,
    harsh_incoherence=0.65,
    soft_corruption=False,
    protocol_bonus=False,
    topic_overrides=False,
    annex_titles=True,
    light_guard=False,
    promotion=False,
    rescored=False,
    pool_limit=None,
    action_floor=0.05,
)

PROFILES = {p.name: p for p in (V2, V1, FEDERATED)}
