"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line: best of three after a warm-up."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession  # noqa: E402

from lociframe.plans import catalog  # noqa: E402

HEADLINE = ["pricing_summary", "filter", "inner_join", "summarize", "row_number", "cumsum", "rank", "top_k", "kmer_count", "kmer_distinct", "fasta_stats", "fn_gc_content", "fn_reverse_complement", "fn_translate", "variant_stats", "variant_summary", "intersect", "overlap_pairs", "merge_intervals", "coverage", "closest", "pivot_wider", "dot", "session_window"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(4):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
