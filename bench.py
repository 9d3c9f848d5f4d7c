"""Seconds for each headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tideflow.queries import QUERIES

HEADLINE = (
    "map_line_revenue", "filter_events", "with_index", "intersperse", "take_while", "distinct_by_user", "dedupe_consecutive", "sort_by_topk",
    "scan_running_value", "running_sum_by", "running_count_by", "frequencies", "to_map_last", "group_by_user", "batch_count", "sliding_window",
    "session_window", "chunk_by_type", "pairwise", "zip_flows", "latest_from", "combine_latest", "lookup_customer", "enrich_orders", "flat_map_words",
    "throttle", "debounce", "key_ttl_reset", "map_with_key_count", "balance",
)


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.time()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "seconds for all headline queries, each the better of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
