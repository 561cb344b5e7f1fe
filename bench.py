"""Times the headline queries; prints one JSON line.

Each query runs over its whole tables into a sink that keeps nothing, after a
small warm-up query.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from strophe.queries import QUERIES

HEADLINE = (
    "tempo_jump_segments", "tempo_pooled_std", "tempo_causal_mean_30s", "tempo_summary", "tempo_features", "seconds_to_ticks", "tempo_smooth",
    "onset_groups", "polyphony", "chord_onset_metrics", "note_coverage", "notes_active_at", "beat_asof", "grid_errors", "grid_stats", "articulation",
    "human_score", "chroma", "key_detect", "chord_classify", "key_segments", "meter_vote", "onset_envelope", "block_rms",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 8))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "4g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("visible_notes")
    for name in HEADLINE:
        times[name] = round(run(name), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
