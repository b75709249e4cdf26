"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
number of local threads (default 8). Two queries that are not timed run first, to
start the Spark and Python workers; every timed query reads its tables anew. The
networks train all their epochs. detector_comparison and experiment_grid are left out:
three detectors trained on half of lineitem, and 60 ratings, each take longer than all
other queries together.
"""

import json
import os
import re
import time

from pyspark.sql import SparkSession

from alarmloom.registry.queries import QUERIES

HEADLINE = [
    "alarm_bands",
    "window_features",
    "packets_with_features",
    "state_event_log",
    "event_durations",
    "directly_follows",
    "variants_topk",
    "variants_coverage",
    "trace_payload_similarity",
    "state_similarity_timing",
    "flow_clean",
    "flow_minmax",
    "protocol_encoded",
    "validation_split",
    "detector_metrics",
    "class_report",
    "detector_membership",
    "states_kmeans",
    "discovered_model",
    "sync_move_counts",
    "rated_alarms",
    "rff_svm_scores",
    "autoencoder_scores",
    "vae_scores",
    "repeated_split",
    "token_replay",
    "capture_ingest",
    "xes_round_trip",
    "cell_states",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("alarmloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["alarm_counts"](spark, sf_dir).collect()
    QUERIES["inference_log_fitness"](spark, "/root/testdata/sf0.001").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    found = re.search(r"sf([\d.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
