"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is materialised whole (noop sink). Every query runs once untimed, so that the timed run
measures the work and not the start and compilation of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from anchorkit import catalog
from anchorkit.session import build_session

HEADLINE = [
    "first_window_means", "first_stay_cohort", "vital_means", "lab_means", "severity_score", "base_feature_table",
    "band_aligned_min", "occupancy_counts", "top_two_chapters", "administrative_columns", "mergeable_means", "score_bands",
    "missing_rates", "quantiles", "stratified_split", "prepared_standard", "class_metrics", "class_auc", "regression_metrics",
    "paired_statistics", "stratified_error", "spearman_table", "text_labels", "ridge_fits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session("bench", f"local[{cpus}]", cpus, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        run(name)
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
