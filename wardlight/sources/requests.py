"""Search requests: defaults for missing fields, blank queries marked."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip

# fixed values: request defaults per profile
_COMMON = {"threshold": 0.0, "safe_top1_guardrail": False, "strict_mode": False, "strict_cds_mode": False,
           "who_first_policy": True, "who_failover_threshold": 5.0, "snippet_chars": 15000}
DEFAULTS = {
    "v2": {**_COMMON, "k": 5, "search_mode": "rrf", "source_mode": "who"},
    "v1": {**_COMMON, "k": 5, "search_mode": "rrf", "source_mode": "who"},
    "v1_federated": {**_COMMON, "k": 3, "search_mode": "bm25", "source_mode": "auto"},
}


def read_requests(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schemas.REQUESTS).format(fmt).load(path)


def with_defaults(requests: DataFrame, profile: str = "v2") -> DataFrame:
    """Requests with every field filled; ``error`` is set on a blank query."""
    types = {f.name: f.dataType for f in schemas.REQUESTS}
    present = set(requests.columns)
    filled = [
        F.coalesce(F.col(n).cast(types[n]), F.lit(d).cast(types[n])).alias(n)
        if n in present else F.lit(d).cast(types[n]).alias(n)
        for n, d in DEFAULTS[profile].items()
    ]
    query = strip(F.coalesce("query", F.lit("")))
    return requests.select(
        "query_id", query.alias("query"), *filled, F.when(query == "", "query_required").alias("error"))
