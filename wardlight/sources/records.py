"""Patient and encounter records."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: The usual number of encounters of a patient that are listed.
ENCOUNTER_LIMIT = 50


def read_patients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PATIENTS).json(path)


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    """Encounters with their observations as VARIANT, which may nest to any depth."""
    return spark.read.schema(schemas.ENCOUNTERS).json(path)


def earliest(encounters: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` encounters of each patient in time order, numbered by ``ord``; n_encounters counts all of them."""
    order = Window.partitionBy("patient_uuid").orderBy(
        F.col("encounterDatetime").try_cast("timestamp").asc_nulls_last(), "uuid")
    every = Window.partitionBy("patient_uuid")
    return encounters.withColumns({"ord": F.row_number().over(order), "n_encounters": F.count("*").over(every)}).where(F.col("ord") <= limit)
