"""Broadcast only what is known to be small."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def broadcast_if(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast if ``rows`` (an upper bound) fit; else leave the join to Spark."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def broadcast_small(df: DataFrame, rows: int, row_bytes: int = 400) -> DataFrame:
    """``broadcast_if`` for dictionary-like tables; ``rows`` is counted or a bound from a count."""
    return broadcast_if(df, rows, row_bytes)
