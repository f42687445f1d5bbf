"""Benchmark: time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed (written to a no-op sink) once after a warm-up
of the JVM, so the number is end-to-end Spark time, not driver collection.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from trailmark.registry.catalog import all_queries  # noqa: E402
from trailmark.session import build_session  # noqa: E402

HEADLINE = [
    "unified_events", "unified_screen_summary_metrics", "unified_pv_engaged_time", "unified_pv_scroll_depth",
    "unified_views", "unified_sessions", "unified_users_sessions", "unified_users_aggs", "unified_users_lasts",
    "unified_users",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session()
    qs = all_queries()
    run(qs["count_events"](spark, sf_dir))  # warm-up: JVM, codegen caches, file listing
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "model_total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
