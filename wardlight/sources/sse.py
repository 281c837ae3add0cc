"""Server-sent event lines."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.text import strip

DONE = "[DONE]"
_SCHEMA = T.StructType(schemas.STREAM_EVENT.fields + [T.StructField("_bad", T.StringType())])


def payload(line: Column) -> Column:
    """Text after ``data: ``; null on other lines."""
    trimmed = strip(line)
    return F.when(trimmed.startswith("data: "), F.substring(trimmed, 7, 1 << 30))


def parse_event(text: Column) -> Column:
    """Event struct; null where the JSON is malformed."""
    event = F.from_json(text, _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return F.when(event["_bad"].isNull(), event)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (stream_id, seq, line) rows from files as they arrive."""
    return spark.readStream.schema("stream_id string, seq bigint, line string").parquet(path)


def decode_sse(lines: DataFrame) -> DataFrame:
    """Events of finished streams: stops at the end mark, skips malformed lines.

    The end mark is found per stream with a partial aggregate; lines themselves
    are not gathered.
    """
    data = lines.select("stream_id", "seq", payload(F.col("line")).alias("_text")).where(F.col("_text").isNotNull())
    ends = data.where(F.col("_text") == DONE).groupBy("stream_id").agg(F.min("seq").alias("_end"))
    open_lines = data.join(ends, "stream_id", "left").where(F.col("_end").isNull() | (F.col("seq") < F.col("_end")))
    events = open_lines.withColumn("event", parse_event(F.col("_text"))).where(F.col("event").isNotNull())
    return events.select("stream_id", "seq", "event.*").drop("_bad")
