"""Seconds per headline query; one JSON line on standard output.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default all)
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from wardline.catalog import load_all  # noqa: E402

HEADLINE = (
    "current_score", "governed_alerts", "governed_alerts_strict", "crossing_streaks", "episodes", "aki_timeline", "sepsis_phenotype",
    "respiratory_score", "organ_totals", "cohort_metrics", "cohort_utility", "bootstrap_intervals", "knob_sweep", "icu_snapshot_scores",
    "pressure_at_infusion", "availability_replay", "study_ablations", "bundle_envelopes", "note_extraction", "feedback_counts", "store_metrics",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("wardline-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.coalescePartitions.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog, seconds = load_all(), {}
    catalog["organ_component_points"].run(spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM and the workers
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        begin = time.time()
        catalog[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
    hours = spark.read.parquet(f"{sf}/events.parquet").count()
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus),
        "cohort_stay_hours_per_sec": round(5 * hours / seconds["cohort_metrics"], 1) if "cohort_metrics" in seconds else None}))


if __name__ == "__main__":
    main()
