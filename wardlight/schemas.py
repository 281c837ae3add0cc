"""Schemas of the tables read and written."""

from pyspark.sql import types as T

_S, _D, _B, _L, _I = T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


CHUNKS_RAW = _struct(
    frame_id=_S, title=_S, snippet=_S, uri=_S, tags=T.ArrayType(_S), track=_S,
    metadata=T.MapType(_S, _S),
)

CHUNKS = _struct(
    frame_id=_S, title=_S, content=_S, source=_S, uri=_S, content_type=_S,
    retrieval_priority=_D, is_current=_B, headings=T.ArrayType(_S), doc_type=_S,
    recommendation_strength=_S, evidence_certainty=_S, source_url=_S, pdf_file=_S,
)

REQUESTS = _struct(
    query_id=_L, query=_S, k=_I, snippet_chars=_I, threshold=_D, search_mode=_S,
    safe_top1_guardrail=_B, source_mode=_S, strict_mode=_B, strict_cds_mode=_B,
    who_first_policy=_B, who_failover_threshold=_D,
)

_DISPLAY = _struct(display=_S)
_MAPPING = _struct(conceptReferenceTerm=_struct(code=_S, conceptSource=_DISPLAY))
_CONCEPT = _struct(
    uuid=_S, display=_S, datatype=_DISPLAY, conceptClass=_DISPLAY,
    mappings=T.ArrayType(_MAPPING),
)


def obs(depth: int) -> T.StructType:
    """An observation whose group members nest ``depth`` levels.

    ``value`` is read as raw JSON text because it may be a number, a string or
    an object.
    """
    fields = dict(uuid=_S, display=_S, concept=_CONCEPT, value=_S)
    if depth > 1:
        fields["groupMembers"] = T.ArrayType(obs(depth - 1))
    else:
        fields["groupMembers"] = T.ArrayType(_struct(uuid=_S))
    return _struct(**fields)


def encounters(depth: int = 4) -> T.StructType:
    return _struct(
        patient_uuid=_S, uuid=_S, encounterDatetime=_S, encounterType=_DISPLAY,
        location=_DISPLAY, obs=T.ArrayType(obs(depth)),
    )


#: Observations as they come, to any depth.
ENCOUNTERS = _struct(patient_uuid=_S, uuid=_S, encounterDatetime=_S, encounterType=_DISPLAY, location=_DISPLAY, obs=T.VariantType())

PATIENTS = _struct(
    uuid=_S, display=_S,
    person=_struct(
        uuid=_S, gender=_S, age=_D, birthdate=_S,
        preferredName=_struct(givenName=_S, familyName=_S),
        attributes=T.ArrayType(_struct(attributeType=_DISPLAY, display=_S, value=_S)),
    ),
    identifiers=T.ArrayType(_struct(identifier=_S, identifierType=_DISPLAY)),
)

STREAM_HIT = _struct(title=_S, content=_S, score=_D, source=_S, uri=_S)
STREAM_EVENT = _struct(
    type=_S, text=_S, turn=_I, query=_S, source=_S, score=_D,
    hits=T.ArrayType(STREAM_HIT), message=_S, turns=_I,
    kb_queries=T.ArrayType(_struct(query=_S, score=_D, source=_S, hits=T.ArrayType(STREAM_HIT))),
)

SERVICE_LOG = _struct(
    ts=T.TimestampType(), level=_S, service=_S, message=_S, query=_S, k=_I, mode=_S,
    client=_S, n_hits=_I, top_score=_D, top_content_type=_S, top_retrieval_priority=_D,
    top1_swapped=_B, quality_flags=T.ArrayType(_S), errors=T.ArrayType(_S), latency_ms=_D,
    trace_id=_S, method=_S, path=_S, status=_I, elapsed_ms=_D,
)

VOCABULARY = _struct(
    categories=T.MapType(
        _S,
        _struct(concepts=T.ArrayType(_struct(
            ciel_id=_L, name=_S, datatype=_S, synonyms=T.ArrayType(_S), units=_S, icd10=_S,
        ))),
    )
)
