"""Times the headline queries on $BENCH_SF_DIR (default sf0.1) with local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "counts_long_filtered", "log1p_cp10k", "clr", "q_scale", "class_scores", "gate_class", "agreement_report", "pearson_by_feature", "auroc", "threshold_otsu",
    "rank_encode", "accuracy_at_matched_coverage", "coverage_curve_tau", "decision_under_edit", "marker_shares", "knn_within_group", "must_separate_sweep",
    "bootstrap_two_stage", "bootstrap_cluster", "crossfit_residuals", "u_shift", "span_loss", "knn_regression", "gap_inference", "method_comparison", "donor_transfer_fits",
]


def main() -> None:
    sys.stdout.flush()
    from strataspark.plans import catalogue
    from strataspark.session import local_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # one untimed pass on the smallest tables starts the JVM's compiler and the Python workers
    warm = os.path.join(os.path.dirname(sf.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        for n in ("accuracy_at_matched_coverage", "crossfit_residuals"):
            catalogue.QUERIES[n](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in HEADLINE:
        t = time.perf_counter()
        catalogue.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
