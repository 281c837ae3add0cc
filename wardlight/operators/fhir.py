"""FHIR resources from accepted items, and the confirmation summary."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# fixed values: code systems and status maps
CATEGORY_SYSTEM = "http://terminology.hl7.org/CodeSystem/observation-category"
CLINICAL_SYSTEM = "http://terminology.hl7.org/CodeSystem/condition-clinical"
VERIFICATION_SYSTEM = "http://terminology.hl7.org/CodeSystem/condition-ver-status"
CIEL_SYSTEM = "https://cielterminology.org"
VERIFICATION = {
    "confirmed": "confirmed", "unconfirmed": "unconfirmed", "absent": "refuted", "ruled_out": "refuted",
}
CONDITION_TEXT = {"confirmed": "Confirmed", "unconfirmed": "Suspected", "absent": "Absent / Ruled out"}

_CODED = "array<struct<system:string,code:string,display:string>>"
#: Members of the resources that ``to_fhir`` writes, for ``from_json``.
RESOURCE = (
    f"resourceType string, status string, category array<struct<coding:{_CODED}>>, code struct<coding:{_CODED},text:string>, "
    "subject struct<reference:string,type:string>, encounter struct<reference:string,type:string>, effectiveDateTime string, "
    f"valueQuantity struct<value:double,unit:string>, valueCodeableConcept struct<coding:{_CODED},text:string>, valueString string, "
    f"clinicalStatus struct<coding:{_CODED}>, verificationStatus struct<coding:{_CODED}>, recordedDate string"
)

_e = lambda f: F.col(f"entry.{f}")


def numeric_value(value: Column) -> Column:
    """Number left after removing all but digits, dot and minus; null if that is none."""
    kept = F.regexp_replace(value, r"[^\d.\-]", "")
    return F.when(~kept.isin("", ".", "-", "-."), kept.try_cast("double"))


def _coding(*fields) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields])


def _code() -> Column:
    display = F.coalesce(_e("display_name"), F.lit(""))
    none = F.lit(None).cast("string")
    return F.struct(
        F.array(
            _coding(("system", none), ("code", _e("local_uuid")), ("display", display)),
            _coding(("system", F.lit(CIEL_SYSTEM)), ("code", _e("ciel_code")), ("display", none)),
        ).alias("coding"),
        display.alias("text"),
    )


def _reference(kind: str, uuid: str) -> Column:
    return F.struct(F.concat(F.lit(f"{kind}/"), F.col(uuid)).alias("reference"), F.lit(kind).alias("type"))


def _status(system: str, code: Column) -> Column:
    return F.struct(F.array(_coding(("system", F.lit(system)), ("code", code))).alias("coding"))


def observation(built_at: Column) -> Column:
    value, kind = F.col("value"), F.coalesce(_e("value_type"), F.lit("Quantity"))
    number = numeric_value(value)
    category = F.coalesce(_e("category"), F.lit("exam"))
    quantity = (kind == "Quantity") & number.isNotNull()
    concept = kind == "CodeableConcept"
    return F.struct(
        F.lit("Observation").alias("resourceType"),
        F.lit("final").alias("status"),
        F.array(F.struct(F.array(_coding(
            ("system", F.lit(CATEGORY_SYSTEM)), ("code", category), ("display", tx.title_case(category)),
        )).alias("coding"))).alias("category"),
        _code().alias("code"),
        _reference("Patient", "patient_uuid").alias("subject"),
        _reference("Encounter", "encounter_uuid").alias("encounter"),
        built_at.alias("effectiveDateTime"),
        F.when(quantity, F.struct(number.alias("value"), F.coalesce(_e("unit"), F.lit("")).alias("unit"))).alias("valueQuantity"),
        F.when(concept, F.struct(F.array(F.struct(value.alias("display"))).alias("coding"), value.alias("text"))).alias("valueCodeableConcept"),
        F.when(~quantity & ~concept, value).alias("valueString"),
    )


def verification(value: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in VERIFICATION.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tx.strip(F.lower(value))), F.lit("confirmed"))


def condition(built_at: Column) -> Column:
    status = verification(F.col("value"))
    return F.struct(
        F.lit("Condition").alias("resourceType"),
        _status(CLINICAL_SYSTEM, F.when(status == "refuted", "inactive").otherwise("active")).alias("clinicalStatus"),
        _status(VERIFICATION_SYSTEM, status).alias("verificationStatus"),
        _code().alias("code"),
        _reference("Patient", "patient_uuid").alias("subject"),
        _reference("Encounter", "encounter_uuid").alias("encounter"),
        built_at.alias("recordedDate"),
    )


def fhir_type() -> Column:
    return F.when(F.col("entry").isNull(), "Observation").otherwise(F.coalesce(_e("fhir_type"), F.lit("Observation")))


def human_readable() -> Column:
    value, display = F.col("value"), _e("display_name")
    known = F.create_map(*[F.lit(x) for pair in CONDITION_TEXT.items() for x in pair])
    status = F.coalesce(F.try_element_at(known, F.lower(value)), tx.title_case(value))
    free = F.concat(tx.title_case(F.translate("label", "_", " ")), F.lit(": "), value)
    unit = F.coalesce(_e("unit"), F.lit(""))
    return (
        F.when(F.col("entry").isNull(), free)
        .when(_e("fhir_type") == "Condition", F.concat(display, F.lit(" — "), status))
        .when(unit != "", F.concat(display, F.lit(" — "), value, F.lit(" "), unit))
        .otherwise(F.concat(display, F.lit(" — "), value))
    )


def to_fhir(items: DataFrame, built_at: Column) -> DataFrame:
    """Add fhir_type, fhir_payload (JSON text; null outside the manifest) and human_readable.

    ``built_at`` is an ISO time text, an argument so that results repeat.
    """
    payload = (
        F.when(F.col("entry").isNull(), F.lit(None).cast("string"))
        .when(fhir_type() == "Observation", F.to_json(observation(built_at)))
        .when(fhir_type() == "Condition", F.to_json(condition(built_at)))
    )
    return items.withColumns({"fhir_type": fhir_type(), "fhir_payload": payload, "human_readable": human_readable()})


def confirm(items: DataFrame, accepted: Column | None = None) -> DataFrame:
    """Status of each item: skipped without a payload, else posted, or failed with an error.

    ``accepted``: whether the receiving side took the resource (default: all).
    """
    ok = accepted if accepted is not None else F.lit(True)
    empty = F.coalesce("fhir_payload", F.lit("")).isin("", "{}")
    return items.withColumns({
        "status": F.when(empty, "skipped").when(ok, "posted").otherwise("failed"),
        "error": F.when(empty, "No FHIR payload"),
    })


def confirm_summary(items: DataFrame, batch: str = "encounter_uuid") -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return items.groupBy(batch).agg(count("posted"), count("failed"), count("skipped"))
