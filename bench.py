"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is executed to completion through the ``noop`` sink (every row
is produced, nothing is collected to the driver). Each query is timed
``RUNS`` times from scratch (a full re-read and recompute each time) and the
best run counts; the metric is the sum over queries. Every query first runs
once on the smallest tables to warm the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ticksmith.plans import catalog  # noqa: E402
from ticksmith.session import build_session  # noqa: E402

RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "indicator_frame",       # Q4: all row indicators, skew-safe blocks
    "sliding_bands",         # A1+A2 fused time windows
    "sliding_bands_by_symbol",
    "macd",
    "rsi_14",
    "sma_50",
    "stream_sliding_bands",  # Q3: decode -> watermark -> windows -> sink
    "stream_ema",            # T12: stateful EMA on a stream
    "normalize_bars",        # Q1: CSV text -> typed bars
    "flatten_history",       # Q2: payloads -> bars
    "latest_n_per_symbol",
    "snapshot",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "8g"})
    # JIT / codegen warm-up on the smallest tables (different data: nothing is reused).
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in HEADLINE:
            catalog.QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(min(runs), 3)
    sf_name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        sf: float | str = float(sf_name)
    except ValueError:
        sf = sf_name
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
