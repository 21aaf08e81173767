"""Headline queries, timed; prints one JSON line.

`BENCH_SF_DIR` names the tables, `BENCH_CPUS` the local cores. Every query runs once to warm up, then three times; the
median counts. Results go to the `noop` sink, so the whole plan runs and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from folioloom.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "combined_filters", "ignore_globs", "ignore_rules", "ignore_rule_table", "file_counts", "remove_comments",
    "remove_empty_lines", "filter_chain", "processed_rows", "line_numbers", "file_blocks", "document_order",
    "ordered_document", "digest_per_group", "written_document", "dry_run", "snapshot_diff", "ref_resolution",
    "url_normalise",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("folioloom-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for _ in range(4):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of median times", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
