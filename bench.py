"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.  Each query runs twice; the second counts."""

import json
import os
import time

from pyspark.sql import SparkSession

from palimpsest.plans.catalog import QUERIES

HEADLINE = (
    "kv_latest_state", "kv_latest_state_window", "kv_snapshot_scan", "kv_scan_range", "kv_get_point", "kv_batch_apply", "kv_sequence_gaps",
    "gc_retain", "gc_drop_counts", "gc_base_level", "lvl_scores", "mf_live_files", "rel_semi_feed", "rel_lookup_join", "rel_duplicates", "rel_orphans",
    "rlog_continuity", "quo_commit_index", "met_operation_summary", "met_recent_percentiles", "pol_write_pressure", "insp_salvage_latest",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))
    spark.stop()


if __name__ == "__main__":
    main()
