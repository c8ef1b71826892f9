"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from tripledger.plans.queries import registered
from tripledger.session import build_session

HEADLINES = [
    "trip_totals",
    "pivot_expenses",
    "trip_rollup",
    "rate_median_fill",
    "one_hot_wide",
    "global_rank",
    "category_shares",
    "minmax_transform",
    "sequence_windows",
    "eval_windows",
    "future_window",
    "breakdown_long",
    "additive_fit",
    "fallback_forecast",
    "evaluate_hybrid",
    "forecast",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    shared = tempfile.mkdtemp(prefix="tripledger-bench-")
    spark = build_session("tripledger-bench", cores=cores, shared=shared)
    queries = registered()
    # One query on the same tables starts the JVM's compilers and fills file caches.
    queries["trip_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
