"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default the headline set), BENCH_REPEAT (default 2).
Each query runs to completion into Spark's ``noop`` sink: every row is computed,
nothing is collected to the driver. ``queries`` holds the best of the repeats
(steady state: codegen and JIT done); ``cold`` holds each query's first run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "topk_accuracy",            # flagship: split → fit → score (BL protocol)
    "phase_topk_accuracy",      # sliding window + replay, all phases (RB protocol)
    "daily_topk_accuracy",      # daily refits + transfer (TL protocol)
    "recommend_topk",
    "follow_stats",
    "history_windows",
    "vocab_items",
    "basket_pairs",
    "event_positions",
]
#: Timed beside the headline; the reported total stays that of the headline queries.
BESIDE = ["train_stats", "recommend_history", "stream_sessions", "stream_model_refresh", "stream_recommend"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + BESIDE)).split(",") if n]
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))

    from seqdrift.config import get_spark
    from seqdrift.catalog import QUERIES

    spark = get_spark(f"local[{cpus}]", app="seqdrift-bench", shuffle_partitions=max(8, cpus),
                      extra={"spark.driver.memory": "16g"})
    # warm-up: JVM, codegen and file listing, excluded from timings
    QUERIES["session_pairs"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times, cold = {}, {}
    for n in names:
        runs = []
        for _ in range(max(1, repeat)):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[n] = round(min(runs), 3)
        cold[n] = round(runs[0], 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(t for n, t in times.items() if n not in BESIDE), 3), "unit": "sec",
                      "queries": times, "cold": cold, "cold_total": round(sum(t for n, t in cold.items() if n not in BESIDE), 3),
                      "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
