"""Patient case text from nested patient and encounter records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.numbers import one_decimal
from ..session import stored

# fixed values: units by concept code, coded and date concepts, prompt frame
UNITS = {
    "5089": "kg", "5090": "cm", "5085": "mmHg", "5086": "mmHg", "5087": "bpm",
    "5088": "C", "5242": "breaths/min", "5092": "%", "21": "g/dL",
    "678": "10^3/uL", "887": "mmol/L", "161439": "", "167209": "cells/hpf",
    "729": "cells/uL", "5497": "cells/uL", "856": "copies/mL", "1342": "mg/dL",
    "790": "mmol/L", "857": "U/L", "1132": "mmol/L", "1133": "mmol/L",
    "1135": "mmol/L", "655": "umol/L", "1825": "g/L",
}
CODED = [
    "1284", "152722", "165268", "120749", "139084", "80", "832", "1169", "5272",
    "299", "5978", "140238", "136443", "143264", "5960", "117671", "1560", "374",
]
DATES = ["5096", "1644", "1427", "164400", "159599", "163526"]
PROMPT = (
    "<bos><start_of_turn>user\n[CDS]\n"
    "Provide evidence-based clinical decision support for this patient.\n\n",
    "<end_of_turn>\n<start_of_turn>model\n",
)


def concept_code(mappings: Column) -> Column:
    """Code of the first mapping to the CIEL terminology."""
    src = lambda m: F.coalesce(m["conceptReferenceTerm"]["conceptSource"]["display"], F.lit(""))
    own = F.filter(mappings, lambda m: (F.upper(src(m)) == "CIEL") | F.contains(src(m), F.lit("Columbia")))
    return F.try_element_at(own, F.lit(1))["conceptReferenceTerm"]["code"]


def strip_code(name: Column) -> Column:
    return tx.strip(F.regexp_replace(name, r"(?U)\s*\(CIEL:\d+\)", ""))


def _is_object(raw: Column) -> Column:
    return raw.startswith("{")


def display_value(raw: Column) -> Column:
    """A value as text; an object shows its ``display``."""
    shown = F.coalesce(F.get_json_object(raw, "$.display"), F.lit("[object Object]"))
    return F.when(raw.isNull(), "").when(_is_object(raw), shown).otherwise(raw)


def leaves(obs: Column, depth: int) -> Column:
    """Observations without members, depth first, in order: array of (concept, value)."""
    leaf = lambda o: F.array(F.struct(o["concept"]["display"].alias("name"), F.coalesce(o["concept"]["datatype"]["display"], F.lit("")).alias("datatype"), concept_code(o["concept"]["mappings"]).alias("code"), o["value"].alias("value")))
    if depth <= 1:
        return F.flatten(F.transform(obs, leaf))
    return F.flatten(F.transform(
        obs, lambda o: F.when(F.size(o["groupMembers"]) > 0, leaves(o["groupMembers"], depth - 1)).otherwise(leaf(o))
    ))


def too_deep(obs: Column, depth: int) -> Column:
    """Number of groups that nest deeper than the declared depth."""
    if depth <= 1:
        return F.aggregate(obs, F.lit(0), lambda n, o: n + F.when(F.size(o["groupMembers"]) > 0, 1).otherwise(0))
    return F.coalesce(F.aggregate(obs, F.lit(0), lambda n, o: n + F.coalesce(too_deep(o["groupMembers"], depth - 1), F.lit(0))), F.lit(0))


def declared_depth(encounters: DataFrame) -> int:
    """Levels of observations that the schema declares; nothing below is read."""
    kind, depth = encounters.schema["obs"].dataType, 0
    while "concept" in kind.elementType.names:
        depth += 1
        if "groupMembers" not in kind.elementType.names:
            break
        kind = kind.elementType["groupMembers"].dataType
    return depth


_CONCEPT = ("struct<display:string,datatype:struct<display:string>,mappings:array<struct<conceptReferenceTerm:"
            "struct<code:string,conceptSource:struct<display:string>>>>>")


def unrolled(encounters: DataFrame) -> DataFrame:
    """row, path and leaf (concept and value) of all observations without members, however deep; ``encounters`` has row and obs as VARIANT.

    A round for each level; only groups go on to the next one.
    """
    members = lambda of, place: F.try_variant_get(of, place, "array<variant>")
    level = encounters.select("row", F.array().cast("array<int>").alias("path"), members("obs", "$").alias("members"))
    found = None
    while True:
        rows = level.select("row", "path", F.posexplode("members").alias("_p", "_o"))
        rows = stored(rows.select("row", F.concat("path", F.array("_p")).alias("path"), F.col("_o").alias("o"), members("_o", "$.groupMembers").alias("members")))
        grouped = F.coalesce(F.size("members") > 0, F.lit(False))
        found = rows.where(~grouped) if found is None else found.union(rows.where(~grouped))
        level = rows.where(grouped)
        if level.isEmpty():
            break
    concept = F.try_variant_get("o", "$.concept", _CONCEPT)
    value = F.try_variant_get("o", "$.value", "variant")
    text = F.when(F.schema_of_variant(value).startswith("OBJECT"), F.to_json(value)).otherwise(value.cast("string"))
    leaf = F.struct(concept["display"].alias("name"), F.coalesce(concept["datatype"]["display"], F.lit("")).alias("datatype"),
                    concept_code(concept["mappings"]).alias("code"), text.alias("value"))
    return found.select("row", "path", leaf.alias("leaf"))


def with_leaves(encounters: DataFrame) -> DataFrame:
    """Encounters with ``leaves`` (observations without members, depth first, in order), n_obs, and deep: groups below the levels that are read.

    Observations that were read as VARIANT are followed to the last level, others to the levels of their schema.
    """
    if not isinstance(encounters.schema["obs"].dataType, T.VariantType):
        depth = declared_depth(encounters)
        return encounters.withColumns({"leaves": leaves(F.col("obs"), depth), "n_obs": F.coalesce(F.size("obs"), F.lit(0)), "deep": too_deep(F.col("obs"), depth)})
    numbered = stored(encounters.withColumn("row", F.monotonically_increasing_id()))
    of_row = unrolled(numbered).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "leaf"))), lambda x: x["leaf"]).alias("leaves"))
    size = F.size(F.try_variant_get("obs", "$", "array<variant>"))
    return numbered.join(of_row, "row", "left").withColumns({"n_obs": F.coalesce(size, F.lit(0)), "deep": F.lit(0)}).drop("row")


def flatten_obs(encounters: DataFrame) -> DataFrame:
    """One row per leaf observation: patient_uuid, encounter_uuid, ord, name, datatype, code, value."""
    rows = with_leaves(encounters).select("patient_uuid", F.col("uuid").alias("encounter_uuid"), F.posexplode("leaves").alias("ord", "_o"))
    return rows.select("patient_uuid", "encounter_uuid", "ord", "_o.*")


def obs_line(o: Column) -> Column:
    """Text line of a leaf observation; null where it is not shown."""
    name = strip_code(F.coalesce(o["name"], F.lit("Unknown")))
    code, kind, raw = o["code"], F.lower(o["datatype"]), o["value"]
    value = display_value(raw)
    answer = F.when(raw.isNull(), "null").otherwise(value)
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    unit = F.coalesce(F.try_element_at(units, code), F.lit(""))
    number = value.rlike(r"^\s*[+-]?(?:\d|\.\d|Infinity)")
    in_set = lambda codes: F.coalesce(code.isin(*codes), F.lit(False))
    body = (
        F.when(in_set(DATES) | kind.isin("date", "datetime"), tx.head(value, 10))
        .when(in_set(CODED) | (kind == "coded"), strip_code(answer))
        .when(value == "", None)
        .when((unit != "") & number, F.concat(value, F.lit(" "), unit))
        .otherwise(value)
    )
    return F.concat(name, F.lit(": "), body)


def header_lines(person: Column, identifiers: Column, ties_to_even: bool = False) -> Column:
    """Age, gender, birthdate and id; an age half way between two tenths goes up, with ``ties_to_even`` to the even one."""
    birth = tx.head(F.coalesce(person["birthdate"], F.lit("")), 10)
    own = F.filter(identifiers, lambda i: F.contains(F.lower(i["identifierType"]["display"]), F.lit("openmrs")))
    chosen = F.coalesce(
        F.try_element_at(own, F.lit(1))["identifier"], F.try_element_at(identifiers, F.lit(1))["identifier"], F.lit("Unknown")
    )
    return F.array(
        F.concat(F.lit("Age: "), F.coalesce(one_decimal(person["age"], ties_to_even), F.lit("0.0"))),
        F.concat(F.lit("Gender: "), tx.head(F.coalesce(person["gender"], F.lit("U")), 1)),
        F.concat(F.lit("Birthdate: "), F.when(birth == "", "1900-01-01").otherwise(birth)),
        F.concat(F.lit("OpenMRS ID: "), chosen),
    )


def attribute_lines(attributes: Column) -> Column:
    def line(a):
        shown = F.when(_is_object(a["value"]), display_value(a["value"])).otherwise(
            F.coalesce(a["display"], a["value"], F.lit("")))
        value = tx.strip(F.when(F.contains(shown, F.lit(" = ")), tx.after(shown, " = ")).otherwise(shown))
        return F.when(value != "", F.concat(F.coalesce(a["attributeType"]["display"], F.lit("")), F.lit(": "), strip_code(value)))

    none = F.array().cast("array<string>")
    return F.coalesce(F.array_compact(F.transform(attributes, line)), none)


def encounter_date(raw: Column) -> Column:
    cut = tx.head(F.coalesce(raw, F.lit("")), 19)
    return F.when((cut != "") & ~F.contains(cut, F.lit("T")), F.concat(tx.head(cut, 10), F.lit("T00:00:00"))).otherwise(cut)


def encounter_lines() -> Column:
    none = F.array().cast("array<string>")
    top = F.array(
        F.concat(F.lit("Visit: "), F.coalesce("encounterType.display", F.lit("Visit"))),
        F.concat(F.lit("Date: "), encounter_date(F.col("encounterDatetime"))),
        F.concat(F.lit("Location: "), F.coalesce("location.display", F.lit("Unknown"))),
    )
    return F.concat(top, F.coalesce(F.array_compact(F.transform("leaves", obs_line)), none))


def case_text(patients: DataFrame, encounters: DataFrame, ties_to_even: bool = False) -> DataFrame:
    """Case text and prompt per patient, with all of the given ``encounters`` in time order.

    Where they are a patient's first ones only (``records.earliest``), encounters_left_out counts the others by
    their ``n_encounters``. A visit is text before it is shuffled; a case is one row, and so one value of a task.
    ``ties_to_even`` is that of ``header_lines``.
    """
    counted = [c for c in encounters.columns if c == "n_encounters"]
    every = F.max("n_encounters") if counted else F.count("*")
    at = F.col("encounterDatetime").try_cast("timestamp")
    visit = F.struct(at.isNull().alias("undated"), at.alias("at"), "uuid", F.array_join(encounter_lines(), "\n").alias("text"))
    visits = with_leaves(encounters).select("patient_uuid", visit.alias("visit"), *counted, "n_obs", "deep").groupBy("patient_uuid").agg(
        F.transform(F.array_sort(F.collect_list("visit")), lambda v: v["text"]).alias("visits"),
        F.count("*").alias("encounter_count"),
        F.sum(F.greatest("n_obs", F.lit(0))).alias("obs_count"),
        F.sum("deep").alias("groups_too_deep"),
        (every - F.count("*")).alias("encounters_left_out"),
    )
    none = F.array().cast("array<string>")
    joined = patients.withColumnRenamed("uuid", "patient_uuid").join(visits, "patient_uuid", "left")
    text = F.array_join(
        F.concat(
            header_lines(F.col("person"), F.col("identifiers"), ties_to_even),
            attribute_lines(F.col("person.attributes")),
            F.coalesce("visits", none),
        ),
        "\n",
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "patient_uuid", text.alias("case_text"),
        F.coalesce("encounter_count", zero).alias("encounter_count"),
        F.coalesce("obs_count", zero).alias("obs_count"),
        F.coalesce("groups_too_deep", zero).alias("groups_too_deep"),
        F.coalesce("encounters_left_out", zero).alias("encounters_left_out"),
    ).withColumn("prompt", F.concat(F.lit(PROMPT[0]), F.col("case_text"), F.lit(PROMPT[1])))
