"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import time

from strandscope.plans import catalogue
from strandscope.session import local_session

HEADLINE = (
    "pair_runs_delta", "pair_runs_summary", "pair_runs_worse", "run_summary_rollup", "signal_snr", "pearson_per_supplier",
    "evaluate_signals", "column_runs", "running_median", "decision_summary", "auroc_retention", "youden_thresholds",
    "class_confusion", "dice_per_label", "confusion_per_region", "rasterise_points", "fit_column_grid",
    "limb_lead_consistency", "parse_headers", "intensity_fingerprint", "split_with_patient_guard", "cache_misses",
    "fill_gaps", "resample_signals", "bootstrap_median_delta",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["finite_filter"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
