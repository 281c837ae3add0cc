"""Sink of confirmed resources: one folder per resource type, plus a status table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fhir import confirm
from ..session import open_files, scratch, stored


_STATUS = ["encounter_uuid", "item_id", "label", "fhir_type", "status", "error"]


def _write(status: DataFrame, folder: str, batch: str) -> None:
    """One folder per batch, overwritten when the batch is repeated. The items are worked out once, for both tables."""
    spark = status.sparkSession
    with scratch(spark), open_files(spark):
        status = stored(status.select(*_STATUS, F.when(F.col("status") == "posted", F.col("fhir_payload")).alias("value")))
        status.where(F.col("status") == "posted").select("fhir_type", "value").write.mode(
            "overwrite").partitionBy("fhir_type").text(f"{folder}/resources/batch={batch}")
        status.select(*_STATUS).write.mode("overwrite").parquet(f"{folder}/results/batch={batch}")


def write_confirmed(items: DataFrame, folder: str, accepted: Column | None = None, batch: str = "0") -> DataFrame:
    """Write payloads by resource type and the status rows of a batch; returns its status rows as written."""
    _write(confirm(items, accepted), folder, batch)
    return items.sparkSession.read.parquet(f"{folder}/results/batch={batch}")


def confirm_batches(folder: str):
    """``foreachBatch`` function that routes each micro-batch to its own folder (safe to repeat)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _write(confirm(batch), folder, str(batch_id))

    return write
