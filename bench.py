"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from motes.plans import catalog  # noqa: E402
from motes.session import session  # noqa: E402

HEADLINE = ["qc_filter", "normalize_anchor", "scale_zscore", "threshold_percentile", "threshold_otsu", "describe_by_sample",
            "rank_sums", "mann_whitney_u", "combo_observed_expected", "combo_empirical_p", "fisher_reference",
            "nearest_reference", "range_join", "bbox_overlap", "greedy_match", "component_signatures", "reference_table",
            "channel_summary", "distance_diagnostics", "density_clusters", "overlap_labels", "image_stats", "laplacian",
            "gaussian_blur", "pixel_components", "region_properties", "manifest_current", "artefact_inventory"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("motes-bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": os.environ.get("BENCH_SHUFFLE", cpus)})
    spark.sparkContext.setLogLevel("ERROR")
    qs = catalog.queries()
    wanted = sys.argv[1:] or HEADLINE
    qs["count_sample_position"](spark, sf).collect()  # JVM warm-up
    times = {}
    for name in wanted:
        best = None
        for _ in range(int(os.environ.get("BENCH_RUNS", "1"))):
            t = time.time()
            qs[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.time() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
