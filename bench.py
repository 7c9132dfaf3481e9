"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the noop sink, which computes all rows and columns. After one warm-up run the
median of three runs counts, like the published rounds it is put next to.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark import registry, session

# Comparable published workflows: training (fit), inference (score) and the queries around them.
HEADLINE = [
    "min_slice",  # features, score, filter, severity, ranking
    "fingerprint_fit",  # training
    "fingerprint_score",  # training and inference
    "day_increments",
    "train_window",
    "travel",
    "rolling_stats",
    "top_users",
    "risk_summary",
    "flow_joined_back",
    "snapshot_features",
    "dlp_risk",
    "weighted_fts",
    "cosine_topk",
    "knn_backfill",
    "khop",
    "neighbour_mean",
    "timeseries_flags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            started = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs[1:]), 4)
    result = {
        "metric": "headline queries, total of medians",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
