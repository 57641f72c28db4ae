"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_QUERIES`` an own list of names
(comma-separated, or ``all``). Every query runs into a no-op sink, so all its rows are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from squelch.plans import catalog  # noqa: E402

HEADLINE = [
    "routing_overview",
    "analysis_overview",
    "label_coverage",
    "facet_filter",
    "review_queue",
    "flattened_segments",
    "nested_labels",
    "constraint_violations",
    "keyword_match",
    "keyword_match_boundary",
    "keyword_score",
    "keyword_table_match",
    "phraseology_issues",
    "match_union",
    "edge_score",
    "top3_matches",
    "rule_matches",
    "event_pairs",
    "speech_segments",
    "clean_chunks",
    "kept_regions",
    "first_free_gap",
    "speaker_turns",
    "readback_mismatch",
    "rapid_exchanges",
    "variations",
    "preference_pairs",
    "augmentation_manifest",
    "chunk_samples",
    "wer",
    "audio_composite",
    "review_apply",
    "upload_append",
    "tumbling_capture",
    "session_transmissions",
]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = HEADLINE
    if wanted:
        names = list(catalog.QUERIES) if wanted == "all" else wanted.split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["routing_overview"](spark, path).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
