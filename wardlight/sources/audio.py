"""Audio uploads: which files need transcoding, read from their headers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the wanted format
RATE, CHANNELS, BITS = 16000, 1, (16, 32)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 44).alias("content"))


def little_endian(content: Column, offset: int, width: int) -> Column:
    """Unsigned number at a 0-based offset."""
    swapped = F.concat(*[F.hex(F.substring(content, offset + i + 1, 1)) for i in reversed(range(width))])
    return F.conv(swapped, 16, 10).cast("bigint")


def triage(uploads: DataFrame) -> DataFrame:
    """Add is_wav, channels, rate, bits, needs_transcode. Only the first 44 bytes matter."""
    content = F.col("content")
    magic = lambda at: F.hex(F.substring(content, at, 4))
    is_wav = (F.octet_length(content) >= 44) & (magic(1) == "52494646") & (magic(9) == "57415645")
    field = lambda offset, width: F.when(F.col("is_wav"), little_endian(content, offset, width))
    out = uploads.withColumn("is_wav", is_wav).withColumns({
        "channels": field(22, 2), "rate": field(24, 4), "bits": field(34, 2)})
    wrong = lambda c, good: F.coalesce((F.col(c) != 0) & ~F.col(c).isin(*good), F.lit(False))
    return out.withColumn(
        "needs_transcode", ~F.col("is_wav") | wrong("rate", [RATE]) | wrong("channels", [CHANNELS]) | wrong("bits", BITS))
