"""Times the headline queries: BENCH_SF_DIR and BENCH_CPUS name the data and the cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from occuflow import catalogue

HEADLINE = [
    "persistence_error", "grid_last", "interp_limit1", "lag_features", "rolling_mp1", "label_valid_mask", "asof_backward_tol", "asof_nearest_tol", "lag24h_exact", "strongest_baseline", "score_cube_margins",
    "certify_prefix", "accuracy_gate", "reliability_slope", "calc_fare_total", "access_decision", "radius_join", "recommend", "spearman_rho", "poll_gaps", "validate_rows", "margin_cube", "stream_dedup_window",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalogue.queries(), {}
    for name in HEADLINE:
        for _ in range(2):  # the second, warm run counts
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total warm time of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
