"""Service logs, as files or as a stream."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SERVICE_LOG).json(path)


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log rows from JSON text lines; malformed lines are dropped."""
    parsed = lines.select(F.from_json(column, schemas.SERVICE_LOG).alias("_r"))
    return parsed.where(F.col("_r.message").isNotNull()).select("_r.*")


def search_log_summary(log: DataFrame) -> DataFrame:
    """Per search mode: requests, answers, empty answers, swaps, worst latency."""
    return log.where(F.col("message").isin("KB search", "KB response")).groupBy("service").agg(
        F.count_if(F.col("message") == "KB search").alias("requests"),
        F.count_if(F.col("message") == "KB response").alias("responses"),
        F.count_if(F.col("n_hits") == 0).alias("empty"),
        F.count_if(F.col("top1_swapped")).alias("swapped"),
        F.max("latency_ms").alias("max_latency_ms"),
    )


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.SERVICE_LOG).json(path)


def request_log(log: DataFrame) -> DataFrame:
    """Finished HTTP requests: of each trace id the first by time, ties by the other columns."""
    done = log.where((F.col("message") == "Request completed") & F.col("trace_id").isNotNull())
    first = F.min(F.struct("ts", "method", "path", "status", "elapsed_ms"))
    return done.groupBy("trace_id").agg(first.alias("_r")).select("trace_id", "_r.*")


def ingest_requests(spark: SparkSession, path: str, out: str, checkpoint: str, delay: str = "1 hour"):
    """Append the request log stream to ``out``; repeated trace ids within ``delay`` are dropped."""
    done = stream_log(spark, path).where((F.col("message") == "Request completed") & F.col("trace_id").isNotNull())
    unique = (
        done.select("trace_id", "ts", "method", "path", "status", "elapsed_ms")
        .withWatermark("ts", delay).dropDuplicatesWithinWatermark(["trace_id"])
    )
    return (
        unique.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
