"""Concept vocabulary from its JSON file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One row per concept, in file order: ord, category and the concept fields."""
    doc = spark.read.schema(schemas.VOCABULARY).json(path, multiLine=True)
    return explode_vocabulary(doc)


def explode_vocabulary(doc: DataFrame) -> DataFrame:
    parts = doc.select(F.posexplode(F.map_entries("categories")).alias("_c", "_e"))
    rows = parts.select("_c", F.col("_e.key").alias("category"), F.posexplode(F.col("_e.value.concepts")).alias("_i", "_k"))
    return rows.select(
        (F.shiftleft(F.col("_c").cast("bigint"), 32) + F.col("_i")).alias("ord"), "category", "_k.ciel_id", "_k.name",
        "_k.datatype", F.coalesce("_k.synonyms", F.array().cast("array<string>")).alias("synonyms"), "_k.units", "_k.icd10")
