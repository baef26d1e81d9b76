"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

A query's time is its best of $BENCH_RUNS runs (3) after one to warm up; p50 and p99 are of the same runs. Where
$BENCH_RATE is set, each query is then called so many times a second for $BENCH_SECONDS (10), whether or not earlier calls
have ended, and `load` has the latencies from when calls were due. `doubts` says why the figures may not be valid.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from tidewake.load import Histogram, doubts, open_loop

QUERIES = ("filter_group_sort", "agg_global", "agg_group_count_sum_min_max_avg", "join_inner", "sort_asc_desc_multi", "asof_inner", "asof_0key", "tumbling_1key", "sliding_p5", "sliding_0key_wide", "compressed_scan", "deep_filter_join_agg_sort")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    unfit = doubts()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidewake.queries import TICKS, queries
    from tidewake.session import shared_folder
    from tidewake.sources import compressed
    from tidewake.types import Schema

    times, rate = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_RATE", "0"))
    known, took, middle, high, loads = queries(), {}, {}, {}, {}
    # encoded once: the scan is timed, as in the baseline
    encoded = shared_folder(spark)
    compressed.write(spark.read.parquet(f"{folder}/events.parquet"), encoded, Schema(TICKS))
    known["compressed_scan"] = lambda session, _: compressed.read(session, encoded, Schema(TICKS))
    for name in QUERIES:
        run = lambda query=known[name]: query(spark, folder).write.format("noop").mode("overwrite").save()
        seen, best = Histogram(), float("inf")
        run()
        for _ in range(times):
            began = time.perf_counter()
            run()
            spent = time.perf_counter() - began
            seen.record(spent)
            best = min(best, spent)
        took[name], middle[name], high[name] = round(best, 4), round(seen.percentile(50), 4), round(seen.percentile(99), 4)
        if rate:
            load = open_loop(run, rate, float(os.environ.get("BENCH_SECONDS", "10")))
            loads[name] = {"p50": round(load.due.percentile(50), 4), "p99": round(load.due.percentile(99), 4), "a_second": round(load.rate, 2), "failed": load.failed}
    out = {"metric": "total of best times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2], "p50": middle, "p99": high, "doubts": unfit}
    print(json.dumps(out | ({"load": loads} if rate else {})))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
