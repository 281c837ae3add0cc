"""Time the headline queries; prints one JSON line."""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Observation  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wardlight.session import local_session  # noqa: E402
from wardlight.workload import queries_search as qs  # noqa: E402
from wardlight.workload import registry  # noqa: E402

HEADLINE = {
    "index_build": "i1_postings",
    "lex_topk": "i2_bm25_topk",
    "sem_topk": "i5_cosine_topk",
    "full_search": "r25_search_responses",
    "fed_search": "v14_federated_responses",
    "kv_extract": "e12_observation_json",
    "transcript_clean": "t9_t10_responses",
    "case_text": "p7_p8_case_text",
}


def run(spark, name, folder):
    """Seconds and rows of one run, with all tables that queries share built anew."""
    qs.reset()
    start, seen = time.time(), Observation()
    registry.QUERIES[name](spark, folder).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return time.time() - start, seen.get["n"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    times, rows = {}, {}
    for label, name in HEADLINE.items():
        _, rows[label] = run(spark, name, folder)  # warm
        times[label] = round(statistics.median(run(spark, name, folder)[0] for _ in range(repeats)), 3)
    n = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cores),
        "rows": rows, "searches_per_sec": round(n / times["full_search"], 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
