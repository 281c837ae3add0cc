"""Concept manifests of encounters."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.sizing import broadcast_small
from ..session import stored

ENTRY_FIELDS = [
    "label", "manifest_line", "ciel_code", "ciel_uuid_full", "local_uuid", "fhir_type",
    "category", "unit", "value_type", "display_name",
]


def padded_code(code: Column) -> Column:
    """Code filled with 32 letters and cut at 36: a 3-digit code gives only 35 characters."""
    return tx.head(F.concat(code, F.lit("A" * 32)), 36)


#: manifest_type of encounters whose type has no list of its own.
DEFAULT_TYPE = ""


def type_entries(concepts: DataFrame, encounter_concepts: DataFrame, concept_ids: DataFrame) -> DataFrame:
    """encounter_type_uuid (null for the default list) and entry (struct), one row per type and concept."""
    local = concept_ids.groupBy("code").agg(F.min("local_uuid").alias("_local"))
    entries = encounter_concepts.join(concepts, "code").join(local, "code", "left")
    full = padded_code(F.col("code"))
    entry = F.struct(
        "ord", "label", "manifest_line", F.col("code").alias("ciel_code"), full.alias("ciel_uuid_full"),
        F.coalesce("_local", full).alias("local_uuid"), "fhir_type", "category", "unit", "value_type",
        tx.title_case(F.translate("label", "_", " ")).alias("display_name"),
    )
    return entries.select("encounter_type_uuid", entry.alias("entry"))


def type_manifests(concepts: DataFrame, encounter_concepts: DataFrame, concept_ids: DataFrame) -> DataFrame:
    """Ordered manifest per encounter type; the default list has a null type."""
    entries = type_entries(concepts, encounter_concepts, concept_ids)
    return entries.groupBy("encounter_type_uuid").agg(F.array_sort(F.collect_list("entry")).alias("manifest"))


def manifest_entries(concepts: DataFrame, encounter_concepts: DataFrame, concept_ids: DataFrame) -> DataFrame:
    """manifest_type, label and entry, written once: the table that observation labels are looked up in."""
    rows = type_entries(concepts, encounter_concepts, concept_ids).select(
        F.coalesce("encounter_type_uuid", F.lit(DEFAULT_TYPE)).alias("manifest_type"), "entry")
    return stored(rows.groupBy("manifest_type", F.col("entry.label").alias("label")).agg(F.min_by("entry", "entry.ord").alias("entry")))


def suffix_entries(entries: DataFrame) -> DataFrame:
    """manifest_type, label (an ending of a manifest label after an underscore) and the first such entry."""
    words = F.split("label", "_")
    endings = F.transform(F.sequence(F.lit(2), F.size(words)), lambda k: F.array_join(F.slice(words, k, F.size(words)), "_"))
    rows = entries.where(F.contains("label", F.lit("_"))).select("manifest_type", "entry", F.explode(endings).alias("label"))
    return rows.where(F.length("label") >= 2).groupBy("manifest_type", "label").agg(F.min_by("entry", "entry.ord").alias("entry"))


def with_manifest_type(encounters: DataFrame, entries: DataFrame) -> DataFrame:
    """Encounters with the manifest_type that applies: their own type if it has entries, else the default."""
    known = entries.select(F.col("manifest_type").alias("encounter_type_uuid"), F.col("manifest_type").alias("_own")).distinct()
    return encounters.join(known, "encounter_type_uuid", "left").withColumn("manifest_type", F.coalesce("_own", F.lit(DEFAULT_TYPE))).drop("_own")


def manifests(encounters: DataFrame, concepts: DataFrame, encounter_concepts: DataFrame,
              concept_ids: DataFrame) -> DataFrame:
    """Encounters with their ``manifest`` array, ``manifest_string`` and ``manifest_labels``; unknown types get the default list."""
    per_type = type_manifests(concepts, encounter_concepts, concept_ids)
    text = F.concat_ws("\n", F.lit("CONCEPTS:"), F.transform("manifest", lambda m: m["manifest_line"]))
    per_type = per_type.withColumn("manifest_string", text)
    per_type = stored(per_type.withColumn("manifest_labels", manifest_labels(F.col("manifest_string"))))  # once a type
    own = broadcast_small(per_type.where(F.col("encounter_type_uuid").isNotNull()), per_type.count())
    default = per_type.where(F.col("encounter_type_uuid").isNull())
    joined = encounters.join(own, "encounter_type_uuid", "left")
    return joined.withColumns({c: F.coalesce(c, default.select(c).scalar()) for c in ("manifest", "manifest_string", "manifest_labels")})


def manifest_rows(encounters_with_manifest: DataFrame) -> DataFrame:
    rows = encounters_with_manifest.select("encounter_uuid", F.explode("manifest").alias("_m"))
    return rows.select("encounter_uuid", "_m.*")


def manifest_labels(manifest_string: Column, audio: bool = False) -> Column:
    """Labels listed in a manifest text, in order, each once."""
    heads = ["CONCEPTS", "AVAILABLE"] if audio else ["CONCEPTS"]

    def label(line):
        bare = tx.strip(F.regexp_replace(tx.strip(line), r"(?U)^\[.*?\]\s*", ""))
        return F.translate(F.lower(tx.strip(tx.before(bare, "("))), " ", "_")

    def listed(line):
        upper = F.upper(tx.strip(line))
        skip = F.lit(False)
        for h in heads:
            skip = skip | upper.startswith(h)
        return (upper != "") & ~skip

    labels = F.transform(F.filter(tx.lines(manifest_string), listed), label)
    return F.array_distinct(F.filter(labels, lambda x: x != ""))


def dictionary_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(concepts, encounter_concepts) as tables; the default list has a null encounter type."""
    from ..rules import concepts as c

    concepts = spark.createDataFrame(
        c.CONCEPTS, "code string, label string, manifest_line string, unit string, fhir_type string, "
        "category string, value_type string")
    rows = [(t, i, code) for t, codes in [*c.ENCOUNTER_CONCEPTS.items(), (None, c.DEFAULT_CONCEPTS)]
            for i, code in enumerate(codes)]
    return concepts, spark.createDataFrame(rows, "encounter_type_uuid string, ord int, code string")
