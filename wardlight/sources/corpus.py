"""Chunk corpus: scan and statistics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Raw chunks with the declared schema; only the columns used are read."""
    return spark.read.schema(schemas.CHUNKS_RAW).parquet(path)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Chunks, files, current chunks and mean length per source."""
    return chunks.groupBy("source").agg(
        F.count("*").alias("n_chunks"),
        F.countDistinct("pdf_file").alias("n_files"),
        F.count_if("is_current").alias("n_current"),
        F.round(F.avg(F.length("content")), 6).alias("mean_chars"),
    )


def vocabulary_summary(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.groupBy("category").agg(F.count("*").alias("n_concepts"))
