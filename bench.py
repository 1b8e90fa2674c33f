"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once over the smallest tables first, so that the times are those of compiled code.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpusmill.plans.queries import QUERIES
from corpusmill.session import local_session

HEADLINE = (
    "file_inventory", "skip_reasons", "category_totals", "clean_text", "token_stats", "duplicate_groups", "largest_files",
    "line_chunks", "batch_packs", "merged_batches", "cache_stats", "budget_admission", "usage_report", "json_repair",
    "typed_analysis", "context_numbers", "declared_types", "function_groups", "branch_scores", "corpus_analysis",
)
WARM_DIR = "/root/testdata/sf0.001"


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        QUERIES[name](spark, WARM_DIR).write.format("noop").mode("overwrite").save()
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
