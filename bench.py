"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local cores. Names given as arguments
restrict the run to these queries. The test tables are files of one row group, which only one core can read; before
anything is timed each is copied once into as many files as there are cores, as tables on a cluster have many.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

from shelfprice import registry

HEADLINE = [
    "price_ranking", "latest_available", "price_history", "search_ranking_unit", "search_offers", "variant_filter",
    "title_quantity", "relevant_pairs", "json_offers", "html_tiles", "tracked_overview", "recent_for_users",
    "discover", "track_from_search", "normalised_text", "stream_best_offer", "relaxed_match", "category_products",
    "listing_detail_join", "stream_rerank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("shelfprice-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # Methods above this size are not compiled by the JVM; Spark then splits them instead.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = registry.queries()
    copy = tempfile.mkdtemp(prefix="bench-")
    for table in sorted(Path(sf_dir).glob("*.parquet")):
        spark.read.parquet(str(table)).repartition(int(cpus)).write.parquet(f"{copy}/{table.name}")
    # Start the JVM and its code cache on a small query before anything is timed.
    registered["run_report"](spark, copy).collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        # The first run compiles, the second one is timed, planning included.
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, copy).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
