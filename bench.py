"""Headline queries at one scale; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names, default the headline list).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from workload.catalog import QUERIES

HEADLINE = (
    "P1_text_key",
    "P10_chunk_texts",
    "C1_region_similarity",
    "C9_class_statistics",
    "C14_score_candidates",
    "C16_suppress_detections",
    "R2_deduplicate",
    "R10_all_pairs",
    "M1_confusion_metrics",
    "M10_seed_summary",
    "B2_replicate_metrics",
    "B5_paired_contrasts",
    "B8_effect_table",
    "A7_knn_contamination",
    "A22_bridge_table",
    "G6_training_table",
    "G8_deletion_negatives",
    "V6_prediction_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pairforge-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the JVM outside the timings
    timings = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
