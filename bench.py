"""Headline queries, timed once each after one warm-up query; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from understory.plans import registry
from understory.session import build_session

QUERIES = [
    "regional_summary", "regression_metrics", "height_error_analysis", "sigma_filter_pair", "prediction_stats",
    "composite_median", "composite_monthly", "composite_monthly_mean", "mosaic_latest", "merge_mosaic", "sample_points",
    "sample_regions", "align_rasters", "resample_bilinear", "prediction_reference_pairs", "shift_aware_loss",
    "patch_neighbors", "standardize_patch_band", "stratified_sample", "focal_mean", "terrain_slope_aspect",
    "augment_spatial", "load_gedi_training", "clean_texture", "stream_monthly_mean",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("region_counts")
    took = {name: round(run(name), 3) for name in QUERIES}
    print(json.dumps({"metric": "total wall seconds of headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
