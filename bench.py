"""Seconds per headline query at one scale factor; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the threads.
Every query computes all its rows (a ``noop`` sink keeps result transfer out).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from tablewright.plans.layout import HOT_ROWS_CONF  # noqa: E402

HEADLINE = (
    "flagship_revenue", "agg_all_functions", "agg_mode", "agg_first_last", "describe_part", "join_two_keys", "join_full", "lookup_last",
    "join_key_report", "union", "window_rank_family", "window_rolling", "window_fill", "window_whole_table", "add_index", "slice_remove_first",
    "top_k_per_group", "dedupe_first", "dedupe_keep", "sample_seeded", "pivot_sum", "fold", "split_all", "unroll", "types_from_text",
    "infer_types", "impute_median", "impute_linear", "fn_string", "fn_date", "fn_math", "fn_json", "profile_numeric", "profile_categorical",
    "histogram", "temporal_counts", "pipeline_job", "multi_model_job",
)
# The same queries with groups of 50 000 rows counted as too large for one task.
DISTRIBUTED = ("add_index", "window_whole_table", "impute_linear", "profile_numeric")
DISTRIBUTED_LIMIT = "50000"


def seconds(spark: SparkSession, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("flagship_revenue", "window_rolling"):  # warm the JVM
        seconds(spark, name, folder)
    times = {name: seconds(spark, name, folder) for name in HEADLINE}
    spark.conf.set(HOT_ROWS_CONF, DISTRIBUTED_LIMIT)
    for name in DISTRIBUTED:
        times[f"{name}_distributed"] = seconds(spark, name, folder)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
