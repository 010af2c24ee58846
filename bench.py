"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
local cores.  Each query is run once to the end; the session is warmed up by a
plain scan first.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from pricelens.catalog import QUERIES
from pricelens.catalog.tables import observations

HEADLINE = [
    "current_week", "historical_stats", "tiered_match", "cross_store_rank", "cross_store_context", "prefix_match",
    "price_parse", "unit_price", "counter_price_fix", "food_filter", "keyword_category", "dedupe_keep_last",
    "archive_append", "new_vs_known", "attach_known", "store_summary", "category_summary", "insights", "score_bands",
    "deals_page_score_desc", "topk_per_store", "price_history", "item_store_stats", "name_clusters", "report_rollup",
    "quarterly_rollup", "page_region_join", "stream_weekly_stats",
]


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pricelens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="pricelens-bench-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    seconds = {}
    start = time.time()
    observations(spark, sf_dir)  # landed once a session; the queries read the finished table
    seconds["landing"] = round(time.time() - start, 2)
    for name in names or HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 2)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 2)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
